"""Catalogue entries: party network (XN) and cloned texts (XC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veeduria.operators import clones as CL
from veeduria.operators import flags as FL
from veeduria.operators.graph import component_sizes, connected_components
from veeduria.plans import oracle as O
from veeduria.plans.catalog import DEFAULT, TEST, register
from veeduria.plans.context import Context

_F01 = O.flag_sql("F01", O.cte_name(DEFAULT), TEST)


@register("xn_components", f"""WITH RECURSIVE {O.ctes([DEFAULT], TEST)},
f01 AS ({_F01}),
e AS (SELECT nit_entidad AS a, documento_proveedor AS b FROM f01
      UNION SELECT documento_proveedor AS a, nit_entidad AS b FROM f01),
r(node, lbl) AS (SELECT a, a FROM e UNION SELECT e.b, r.lbl FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(lbl) AS component FROM r GROUP BY node)
SELECT c.component, c.node, s.size FROM c
JOIN (SELECT component, count(*) AS size FROM c GROUP BY component) s USING (component)""")
def xn(ctx: Context):
    """XN network of buyers and suppliers linked by splitting alerts (F01):
    connected components by pointer jumping."""
    a = FL.f01_split(ctx.contracts(DEFAULT, TEST), TEST)
    edges = a.select(F.col("nit_entidad").alias("src"), F.col("documento_proveedor").alias("dst"))
    return component_sizes(connected_components(edges))


_NORM = "trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))"


@register("xc_clones", f"""
WITH h AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents WHERE text IS NOT NULL),
g AS (SELECT h, min(doc_id) AS grupo, count(*) AS n FROM h GROUP BY h HAVING count(*) >= 2)
SELECT h.doc_id, g.grupo, g.n FROM h JOIN g USING (h)""")
def xc(ctx: Context):
    """XC exact copies of whole document texts (normalised whitespace)."""
    return CL.exact_clones(ctx.tables.documents, "doc_id", "text")


_NEAR = f"""WITH RECURSIVE w AS (
  SELECT doc_id, string_split(lower({_NORM}), ' ') AS w FROM documents WHERE text IS NOT NULL AND {_NORM} <> ''),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
         GROUP BY 1, 2),
e AS (SELECT x AS a, y AS b FROM common JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y
      WHERE 100 * k >= 75 * (p.n + q.n - k)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, lbl) AS (SELECT a, a FROM d UNION SELECT d.b, r.lbl FROM r JOIN d ON d.a = r.node),
c AS (SELECT node, min(lbl) AS grupo FROM r GROUP BY node)
SELECT c.node AS doc_id, c.grupo, s.n FROM c JOIN (SELECT grupo, count(*) AS n FROM c GROUP BY 1) s USING (grupo)"""


@register("xc_near_clones", _NEAR)
def xc_near(ctx: Context):
    """XC near copies: exact set-similarity join of word shingles, groups of
    linked documents."""
    return CL.near_clones(ctx.tables.documents, "doc_id", "text")
