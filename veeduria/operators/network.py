"""Party network (XN): buyers, suppliers and their legal representatives.

The graph has three kinds of nodes and an edge for each pair that some
contract joins: buyer and supplier, supplier and representative. A buyer
that everyone sells to, or a name that stands for everyone, would tie all
into one lump; nodes with more than ``max_degree`` neighbours are hubs, listed
as such and taken out, together with nothing else. What is left is cut down
to its k-core: nodes with fewer than k neighbours go, again and again, until
all have k. The core's connected components are clusters of parties that
share partners. Edges are never turned into pairs of nodes with a common
neighbour, so no hub or cluster makes more rows than it has edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.operators.graph import component_sizes, connected_components
from veeduria.session import drop_written, reuse

KINDS = {"E": "entidad", "S": "contratista", "R": "representante"}


def _node(kind: str, col: str):
    return F.concat(F.lit(f"{kind}:"), F.col(col))


def party_edges(c: DataFrame) -> DataFrame:
    """(a, b, n): pairs of parties joined by contracts, and how many. One
    aggregate of the contracts by party triple feeds both kinds of edges."""
    t = (c.where(F.col("documento_proveedor").isNotNull())
          .groupBy("nit_entidad", "documento_proveedor", F.col("identificaci_n_representante_legal").alias("rep"))
          .agg(F.count(F.lit(1)).alias("n")))
    s = _node("S", "documento_proveedor")
    pairs = t.select("n", F.explode(F.array(F.struct(_node("E", "nit_entidad").alias("a"), s.alias("b")),
                                            F.struct(s.alias("a"), _node("R", "rep").alias("b")))).alias("e"))
    return (pairs.select("e.a", "e.b", "n").where(F.col("a").isNotNull() & F.col("b").isNotNull())
                 .groupBy("a", "b").agg(F.sum("n").alias("n")))


def degrees(edges: DataFrame) -> DataFrame:
    """(nodo, grado): neighbours per node of distinct edges."""
    return edges.select(F.explode(F.array("a", "b")).alias("nodo")).groupBy("nodo").agg(F.count(F.lit(1)).alias("grado"))


def kind_of(node: str):
    return F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.substring(node, 1, 1))


def hubs(c: DataFrame, max_degree: int) -> DataFrame:
    """(nodo, tipo, grado): the nodes that are left out as hubs."""
    d = degrees(party_edges(c)).where(F.col("grado") > max_degree)
    return d.select("nodo", kind_of("nodo").alias("tipo"), "grado")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``nodes`` (nodo)."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("nodo").alias(end)), end, "left_anti")
    return edges.select("a", "b", "n")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the nodes that keep k neighbours when all others go. Each
    round is written and the one before deleted; the driver sees a count."""
    core = reuse(edges)
    while True:
        weak = degrees(core).where(F.col("grado") < k)
        left = reuse(without(core, weak))
        done = left.count() == core.count()
        drop_written(core)
        core = left
        if done:
            return core


def party_clusters(c: DataFrame, k: int = 2, max_degree: int = 50) -> DataFrame:
    """(cluster, nodo, tipo, grado, tamano): the k-core without hubs; a
    cluster is named by its smallest node, ``grado`` counts neighbours in it."""
    edges = reuse(party_edges(c))
    core = k_core(without(edges, degrees(edges).where(F.col("grado") > max_degree)), k)
    cc = component_sizes(connected_components(core, "a", "b"))
    return (cc.join(degrees(core), F.col("node") == F.col("nodo"))
              .select(F.col("component").alias("cluster"), "nodo", kind_of("nodo").alias("tipo"), "grado",
                      F.col("size").alias("tamano")))
