"""Catalogue entries: scores and flag summary."""

from __future__ import annotations

from veeduria.operators import flags as FL
from veeduria.operators import scores as S
from veeduria.params import FLAG_DESCRIPTIONS
from veeduria.plans import oracle as O
from veeduria.plans.catalog import DEFAULT, TEST, alerts_df, register, with_alerts, with_ctes
from veeduria.plans.context import Context
from veeduria.session import reuse


def _score_sql(key: str, label: str) -> str:
    return with_alerts(
        f"SELECT {key} AS key, max({label}) AS label, CAST(least(100, sum(severidad)) AS INTEGER) AS score,"
        f" CAST(sum(severidad) AS BIGINT) AS raw_score,"
        f" percent_rank() OVER (ORDER BY sum(severidad)) AS pct_rank, count(*) AS n_alertas,"
        f" CAST(sum(valor_cop) AS DOUBLE) AS valor_bajo_alerta,"
        f" array_to_string(list_sort(list(DISTINCT codigo)), ',') AS banderas"
        f" FROM alertas WHERE {key} IS NOT NULL GROUP BY {key}")


@register("r02_entity_score", _score_sql("nit_entidad", "nombre_entidad"))
def r02(ctx: Context):
    """R2 buyer risk score."""
    return S.entity_scores(alerts_df(ctx))


@register("r03_supplier_score", _score_sql("documento_proveedor", "proveedor"))
def r03(ctx: Context):
    """R3 supplier risk score."""
    return S.supplier_scores(alerts_df(ctx))


def _shared_alerts_cte() -> str:
    body = "\nUNION ALL\n".join(f"({O.flag_sql(k, O.cte_name(DEFAULT), TEST)})" for k in FL.REGISTRY)
    return f"alertas AS ({body})"


_svc = O.ilike_any("tipo_de_contrato", TEST.service)
_M13 = with_ctes(f"""
SELECT id_contrato AS key, CAST(least(100, sum(severidad)) AS INTEGER) AS score,
       CAST(sum(severidad) AS BIGINT) AS raw_score, count(*) AS n_alertas,
       array_to_string(list_sort(list(DISTINCT codigo)), ',') AS banderas
FROM (
  SELECT c.id_contrato, a.codigo, a.severidad FROM {O.cte_name(DEFAULT)} c JOIN alertas a
    ON a.codigo = 'F01' AND c.es_sin_competencia AND c.nit_entidad = a.nit_entidad
   AND c.documento_proveedor = a.documento_proveedor AND c.anio = a.anio
  UNION ALL
  SELECT c.id_contrato, a.codigo, a.severidad FROM {O.cte_name(DEFAULT)} c JOIN alertas a
    ON a.codigo = 'F02' AND c.documento_proveedor = a.documento_proveedor AND c.anio = a.anio
  UNION ALL
  SELECT c.id_contrato, a.codigo, a.severidad FROM {O.cte_name(DEFAULT)} c JOIN alertas a
    ON a.codigo = 'F06' AND c.es_persona_natural AND {_svc.replace('tipo_de_contrato', 'c.tipo_de_contrato')}
   AND c.documento_proveedor = a.documento_proveedor AND c.anio = a.anio
  UNION ALL
  SELECT c.id_contrato, a.codigo, a.severidad FROM {O.cte_name(DEFAULT)} c JOIN alertas a
    ON a.codigo IN ('F04', 'F08') AND c.nit_entidad = a.nit_entidad AND c.anio = a.anio
  UNION ALL
  SELECT id_contrato, codigo, severidad FROM alertas WHERE codigo IN ('F09', 'F10') AND id_contrato IS NOT NULL
) GROUP BY id_contrato""", [DEFAULT], _shared_alerts_cte())


@register("m13_contract_score", _M13)
def m13(ctx: Context):
    """M13 contract-level score on one binding (alerts with shared aggregates)."""
    ctx.keep(payments=False)
    c = ctx.contracts(DEFAULT, TEST)
    a = reuse(FL.run_flags_shared(c, TEST))     # flags run once, both link kinds read it
    return S.contract_scores(c, a, TEST)


_DESC = ", ".join(f"({O.q(k)}, {O.q(v)})" for k, v in sorted(FLAG_DESCRIPTIONS.items()))


@register("r04_flag_summary", with_alerts(
    f"SELECT s.*, d.descripcion FROM (SELECT codigo, max(bandera) AS bandera, count(*) AS n,"
    f" CAST(sum(valor_cop) AS DOUBLE) AS valor, {O.rnd(O.dbl('sum(valor_cop)') + ' / 1e9', 1)} AS v"
    f" FROM alertas GROUP BY codigo) s LEFT JOIN (VALUES {_DESC}) d(codigo, descripcion) USING (codigo)"))
def r04(ctx: Context):
    """R4 + R6 alerts and value per flag with its description."""
    return S.flag_summary(alerts_df(ctx))


@register("r05_total", with_alerts("SELECT count(*) AS n FROM alertas"))
def r05(ctx: Context):
    """R5 total number of alerts."""
    return S.alert_total(alerts_df(ctx))
