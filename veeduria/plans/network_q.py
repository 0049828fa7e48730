"""Catalogue entries: the party network (XN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veeduria.operators import network as N
from veeduria.plans import oracle as O
from veeduria.plans.catalog import CUSTOMER_SUPPLIER, TEST, register, with_ctes
from veeduria.plans.context import Context

CS = O.cte_name(CUSTOMER_SUPPLIER)
#: Large contracts only, so that the graph of the test tables is sparse.
MIN_VALUE = 102_000
MAX_DEGREE, CORE = 4, 2
ROUNDS = 24

_EDGES = f"""
t AS (SELECT nit_entidad AS e, documento_proveedor AS s, identificaci_n_representante_legal AS r FROM {CS}
      WHERE documento_proveedor IS NOT NULL AND valor_del_contrato > {MIN_VALUE}),
g AS (SELECT 'E:' || e AS a, 'S:' || s AS b FROM t WHERE e IS NOT NULL
      UNION SELECT 'S:' || s, 'R:' || r FROM t WHERE r IS NOT NULL),
dg AS (SELECT nodo, count(*) AS grado FROM (SELECT a AS nodo FROM g UNION ALL SELECT b FROM g) GROUP BY 1)"""
_KIND = "CASE left(nodo, 1) WHEN 'E' THEN 'entidad' WHEN 'S' THEN 'contratista' ELSE 'representante' END"


def _round(i: int) -> str:
    weak = (f"(SELECT nodo FROM (SELECT a AS nodo FROM k{i - 1} UNION ALL SELECT b FROM k{i - 1}) GROUP BY 1"
            f" HAVING count(*) < {CORE})")
    return f"k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} WHERE a NOT IN {weak} AND b NOT IN {weak})"


_CORE = (f"k0 AS MATERIALIZED (SELECT * FROM g WHERE a NOT IN (SELECT nodo FROM dg WHERE grado > {MAX_DEGREE})"
         f" AND b NOT IN (SELECT nodo FROM dg WHERE grado > {MAX_DEGREE})),\n"
         + ",\n".join(_round(i) for i in range(1, ROUNDS + 1)))


def _contracts(ctx: Context):
    return ctx.contracts(CUSTOMER_SUPPLIER, TEST).where(F.col("valor_del_contrato") > MIN_VALUE)


@register("xn_hubs", with_ctes(f"SELECT nodo, {_KIND} AS tipo, grado FROM dg WHERE grado > {MAX_DEGREE}",
                               [CUSTOMER_SUPPLIER], _EDGES))
def xn_hubs(ctx: Context):
    """XN parties with too many partners to tie a cluster."""
    return N.hubs(_contracts(ctx), MAX_DEGREE)


@register("xn_clusters", f"""WITH RECURSIVE {O.ctes([CUSTOMER_SUPPLIER], TEST)},
{_EDGES},
{_CORE},
d AS (SELECT a, b FROM k{ROUNDS} UNION SELECT b, a FROM k{ROUNDS}),
r(node, lbl) AS (SELECT a, a FROM d UNION SELECT d.b, r.lbl FROM r JOIN d ON d.a = r.node),
c AS (SELECT node, min(lbl) AS cluster FROM r GROUP BY node)
SELECT c.cluster, c.node AS nodo, {_KIND.replace('nodo', 'c.node')} AS tipo, x.grado, s.tamano FROM c
JOIN (SELECT a, count(*) AS grado FROM d GROUP BY 1) x ON x.a = c.node
JOIN (SELECT cluster, count(*) AS tamano FROM c GROUP BY 1) s USING (cluster)""")
def xn_clusters(ctx: Context):
    """XN clusters of buyers, suppliers and representatives in the 2-core."""
    return N.party_clusters(_contracts(ctx), CORE, MAX_DEGREE)
