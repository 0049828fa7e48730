"""Catalogue entries: evidence dossiers (R27), flattened to one row per
evidence contract for the oracle."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.operators import dossier as D
from veeduria.plans import oracle as O
from veeduria.plans.catalog import ALL_BINDINGS, FLAG_BINDING, TEST, alerts_cte, alerts_df, register
from veeduria.plans.context import Context
from veeduria.session import reuse

ORDER_SQL = ("severidad DESC, valor_cop DESC, codigo ASC, nit_entidad ASC NULLS LAST, "
             "documento_proveedor ASC NULLS LAST, id_contrato ASC NULLS LAST, anio ASC NULLS LAST, "
             "detalle ASC NULLS LAST")


def build(ctx: Context, n: int, per_flag: int | None, mode: str) -> DataFrame:
    a = alerts_df(ctx)
    top = reuse(D.top_alerts(a, n, per_flag))   # flags run once for all bindings
    parts = []
    for b in ALL_BINDINGS:
        codes = [k for k, v in FLAG_BINDING.items() if v == b]
        parts.append(D.evidence(ctx.contracts(b, TEST), top, 10, mode, TEST, codes,
                                top_rows=D.top_bound(n, per_flag)))
    ev = functools.reduce(DataFrame.unionByName, parts)
    head = top.select("rank", "codigo", "bandera", F.col("nombre_entidad").alias("a_entidad"),
                      F.col("proveedor").alias("a_proveedor"), F.col("anio").alias("a_anio"), "detalle",
                      "valor_cop", "severidad")
    return head.join(ev, "rank")


def _sql(n: int, per_flag: int | None, mode: str) -> str:
    if per_flag:
        top = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY {ORDER_SQL}) AS k"
               f" FROM alertas) WHERE k <= {per_flag}")
    else:
        top = f"SELECT * FROM alertas ORDER BY {ORDER_SQL} LIMIT {n}"
    p = TEST
    exact = ""
    if mode == "exact":
        svc = O.ilike_any("c.tipo_de_contrato", p.service)
        vag = O.ilike_any("c.objeto_del_contrato", p.vague)
        exact = (f" AND (t.codigo <> 'F01' OR c.es_sin_competencia)"
                 f" AND (t.codigo <> 'F06' OR (c.es_persona_natural AND {svc}))"
                 f" AND (t.codigo <> 'F09' OR ({vag} AND c.valor_del_contrato > {p.f09_min_value}))"
                 f" AND (t.codigo <> 'F10' OR ("
                 f"c.dias_adicionados >= {p.f10_min_days} AND c.valor_del_contrato > {p.f10_min_value}))")
    evs = []
    for b in ALL_BINDINGS:
        codes = ", ".join(O.q(k) for k, v in FLAG_BINDING.items() if v == b)
        by_keys = ("(t.nit_entidad IS NOT NULL OR t.documento_proveedor IS NOT NULL)"
                   " AND (t.nit_entidad IS NULL OR c.nit_entidad = t.nit_entidad)"
                   " AND (t.documento_proveedor IS NULL OR c.documento_proveedor = t.documento_proveedor)")
        if mode == "exact":
            # the month of a spike stands in its detail text
            match = f"""CASE WHEN t.codigo IN ('F09', 'F10') THEN c.id_contrato = t.id_contrato
   WHEN t.codigo = 'F03' THEN c.nit_entidad = t.nit_entidad
     AND contains(t.detalle, ' firmados en ' || strftime(c.fecha_de_firma, '%Y-%m') || ' ')
   ELSE {by_keys} AND c.anio = t.anio END"""
        else:
            match = f"{by_keys} AND (t.codigo = 'F06' OR c.anio = t.anio)"
        evs.append(f"SELECT t.rank, c.* FROM top t JOIN {O.cte_name(b)} c\n  ON t.codigo IN ({codes}) AND {match}{exact}")
    ev = "\nUNION ALL\n".join(evs)
    one_line = "regexp_replace(e.objeto_del_contrato, '[\\r\\n]+', ' ', 'g')"
    obj = f"left({O.strip(one_line)}, 160)"
    return f"""WITH {alerts_cte()},
top AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM ({top})),
ev AS ({ev}),
evr AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY valor_del_contrato DESC, id_contrato ASC,
          proceso_de_compra ASC, fecha_de_firma ASC, objeto_del_contrato ASC NULLS LAST) AS ev_rank FROM ev)
SELECT CAST(t.rank AS INTEGER) AS rank, t.codigo, t.bandera, t.nombre_entidad AS a_entidad, t.proveedor AS a_proveedor, t.anio AS a_anio,
       t.detalle, CAST(t.valor_cop AS DOUBLE) AS valor_cop, t.severidad, CAST(e.ev_rank AS INTEGER) AS ev_rank, e.id_contrato,
       e.proceso_de_compra, CAST(CAST(e.fecha_de_firma AS DATE) AS VARCHAR) AS firma, e.nombre_entidad,
       e.proveedor_adjudicado, e.modalidad_de_contratacion AS modalidad,
       CAST(round(e.valor_del_contrato / 1000000) AS BIGINT) AS millones, e.dias_adicionados,
       {obj} AS objeto
FROM top t JOIN evr e ON t.rank = e.rank WHERE e.ev_rank <= 10"""


@register("r27_dossier_top", _sql(15, None, "keys"))
def r27_top(ctx):
    """R27 dossiers of the 15 most severe alerts, evidence by keys (published)."""
    return build(ctx, 15, None, "keys")


@register("r27_dossier_keys", _sql(0, 2, "keys"))
def r27_keys(ctx):
    """R27 dossiers, top 2 alerts of every flag, evidence by keys."""
    return build(ctx, 0, 2, "keys")


@register("r27_dossier_exact", _sql(0, 2, "exact"))
def r27_exact(ctx):
    """R27 dossiers, top 2 alerts of every flag, evidence by the flag's own predicate."""
    return build(ctx, 0, 2, "exact")
