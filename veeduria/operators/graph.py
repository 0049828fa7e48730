"""Connected components by hooking and pointer jumping (XN, XC).

Every node points to a smaller or equal node, at first to its smallest
neighbour. A round sends the grandparents along the edges, hooks a node and
its parent under the smallest one seen, and replaces each pointer by the
pointer's pointer. Trees are halved in depth every round, so the number of
rounds grows with the logarithm of the longest path, and the loop runs until
no grandparent changes: there is no round limit. The minimum is
pre-aggregated in each task before the shuffle, so a hub node does not
gather its edges in one task. After each round the pointer table is written
to the shared checkpoint folder, which cuts the lineage and survives
executor loss; the table it replaces is deleted. Only the number of changed
nodes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.session import drop_written, reuse


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the
    component id is the smallest node id in it. Edges with a null end are
    left out; loops and repeated edges do no harm."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    both = reuse(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = reuse(_grandparents(both.groupBy(F.col("a").alias("node"))
                                    .agg(F.least(F.col("a"), F.min("b")).alias("parent"))))
    while True:
        old = state
        seen = (both.join(old.select(F.col("node").alias("b"), "grand"), "b")
                    .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("seen")))
        x = old.join(seen, "node", "left").withColumn("seen", F.least("seen", "grand"))
        hooked = x.select(F.explode(F.array(
            F.struct("node", F.least("parent", "seen").alias("parent")),
            F.struct(F.col("parent").alias("node"), F.col("seen").alias("parent")))).alias("h")).select("h.*")
        new = _grandparents(hooked.groupBy("node").agg(F.min("parent").alias("parent")))
        state = reuse(new.join(old.select("node", F.col("grand").alias("before")), "node"))
        changed = state.where(F.col("grand") < F.col("before")).count()
        state = state.drop("before")
        drop_written(old)
        if not changed:
            drop_written(both)
            return state.select("node", F.col("grand").alias("component"))


def _grandparents(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(up, "parent").select("node", "parent", "grand")


def component_sizes(cc: DataFrame) -> DataFrame:
    """Adds the size of each node's component."""
    sizes = cc.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return cc.join(sizes, "component")
