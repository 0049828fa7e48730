"""Reporting queries (R7-R14, R23-R26, R28) and their catalogue entries.

Every report is a declarative DataFrame plan; top-N lists use
``orderBy(...).limit(n)`` (planned as TakeOrderedAndProject: a per-task
top-N, then a merge of N rows per task), never a global sort.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.functions.fmt import bn, mm
from veeduria.operators import scores as S
from veeduria.plans import oracle as O
from veeduria.plans.catalog import (CUSTOMER_SUPPLIER, DEFAULT, NATION_SUPPLIER, TEST, alerts_cte,
                                    alerts_df, register, with_ctes)
from veeduria.plans.context import Context


def _v():
    """The contract value column."""
    return F.col("valor_del_contrato")


CC = O.cte_name(DEFAULT)


# ------------------------------------------------------------ operators ---

def kpi(c: DataFrame) -> DataFrame:
    """R7 national KPIs (one global aggregate; count-distincts are planned
    as a distributed two-level aggregate)."""
    nc = F.sum(F.when(F.col("es_sin_competencia"), _v()))
    return c.agg(
        F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor_total"),
        nc.alias("valor_sin_competencia"),
        F.round(F.lit(100.0) * F.coalesce(nc, F.lit(0)).cast("double") / F.sum(_v()).cast("double"), 0)
         .alias("pct_sin_competencia"),
        F.countDistinct("nit_entidad").alias("entidades"),
        F.countDistinct("documento_proveedor").alias("proveedores"),
        F.to_date(F.min("fecha_de_firma")).alias("desde"),
        F.to_date(F.max("fecha_de_firma")).alias("hasta"))


def alert_kpi(a: DataFrame) -> DataFrame:
    """R8 alerts and value under alert."""
    return a.agg(F.count(F.lit(1)).alias("n"), F.sum("valor_cop").alias("v"))


def top_scores(scores: DataFrame, n: int = 10, named_only: bool = False) -> DataFrame:
    """R9/R10 top-N by score then value under alert (key breaks ties)."""
    s = scores.where(F.col("label").isNotNull()) if named_only else scores
    return (s.orderBy(F.desc("score"), F.desc("valor_bajo_alerta"), F.asc("key")).limit(n)
             .select("key", F.col("label").alias("nombre"), "score", F.col("n_alertas").alias("alertas"),
                     bn("valor_bajo_alerta", 1).alias("v")))


def entity_departments(c: DataFrame) -> DataFrame:
    """Distinct (buyer, department) pairs: many per buyer possible."""
    return c.where(F.col("nit_entidad").isNotNull()).select("nit_entidad", "departamento").distinct()


def modal_departments(c: DataFrame) -> DataFrame:
    """One department per buyer: the one with most contracts (name breaks
    ties). The window runs over the small (buyer, department) aggregate."""
    g = (c.where(F.col("nit_entidad").isNotNull() & F.col("departamento").isNotNull())
          .groupBy("nit_entidad", "departamento").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("nit_entidad").orderBy(F.desc("n"), F.asc("departamento"))
    return g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("nit_entidad", "departamento")


def value_by_buyer(a: DataFrame) -> DataFrame:
    """Value under alert per buyer, a row each: the many alerts of a large
    buyer are added up within the tasks, not moved to one for a join."""
    return a.where(F.col("nit_entidad").isNotNull()).groupBy("nit_entidad").agg(F.sum("valor_cop").alias("valor_cop"))


def geography(a: DataFrame, dims: DataFrame, n: int = 12) -> DataFrame:
    """R11 value under alert per department, top-N. With ``entity_departments``
    a buyer present in k departments counts k times (fan-out, as published);
    with ``modal_departments`` once. The dimension grows with the number of
    buyers, so the join strategy is AQE's (runtime size), not a hint."""
    j = value_by_buyer(a).join(dims, "nit_entidad").where(F.col("departamento").isNotNull())
    g = j.groupBy("departamento").agg(F.sum("valor_cop").alias("valor"))
    return (g.orderBy(F.desc("valor"), F.asc("departamento")).limit(n)
             .select(F.col("departamento").alias("d"), "valor", bn("valor", 1).alias("v")))


def flag_labels(a: DataFrame) -> DataFrame:
    """R12 'code: name' labels."""
    return a.select(F.concat_ws(": ", "codigo", "bandera").alias("b")).distinct()


def _alert_order():
    return [F.desc("severidad"), F.desc("valor_cop"), F.asc("codigo"), F.asc_nulls_last("nit_entidad"),
            F.asc_nulls_last("documento_proveedor"), F.asc_nulls_last("id_contrato"),
            F.asc_nulls_last("anio"), F.asc_nulls_last("detalle")]


def alert_feed(a: DataFrame, codes: list[str], n: int = 500) -> DataFrame:
    """R13 alert feed filtered by flag codes (an empty list gives no rows)."""
    f = a.where(F.col("codigo").isin(codes)) if codes else a.where(F.lit(False))
    return (f.orderBy(*_alert_order()).limit(n)
             .select("codigo", "bandera", F.coalesce("nombre_entidad", F.lit("")).alias("entidad"),
                     F.coalesce("proveedor", F.lit("")).alias("contratista"), "detalle",
                     mm("valor_cop", 1).alias("valor_m"), "severidad"))


def top_alerts(a: DataFrame, n: int = 12) -> DataFrame:
    """R14 most severe alerts."""
    return (a.orderBy(*_alert_order()).limit(n)
             .select("codigo", "bandera", F.coalesce("nombre_entidad", F.lit("")).alias("entidad"),
                     F.coalesce("proveedor", F.lit("")).alias("contratista"), "detalle",
                     bn("valor_cop", 2).alias("v")))


def daily(c: DataFrame) -> DataFrame:
    """R23 contracts and value per signature day."""
    return (c.groupBy(F.to_date("fecha_de_firma").alias("dia"))
             .agg(F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor")))


def weekly(c: DataFrame) -> DataFrame:
    """R24 contracts and value per Monday-based week."""
    return (c.groupBy(F.trunc(F.to_date("fecha_de_firma"), "week").alias("d"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("valor"))
             .withColumn("v", bn("valor", 2)))


def month_modality(c: DataFrame, top: int = 6) -> DataFrame:
    """R25 value per month and modality, for the top modalities by value.
    The top list has at most ``top`` rows, so broadcasting it is bounded."""
    g = (c.groupBy(F.col("mes_firma").alias("mes"), F.col("modalidad_de_contratacion").alias("modalidad"))
          .agg(F.sum(_v()).alias("valor")).where(F.col("valor") > 0))
    tops = (g.groupBy("modalidad").agg(F.sum("valor").alias("t"))
             .orderBy(F.desc("t"), F.asc_nulls_last("modalidad")).limit(top).select("modalidad"))
    return g.join(F.broadcast(tops), g["modalidad"].eqNullSafe(tops["modalidad"]), "left_semi")


def modality_totals(c: DataFrame, top: int = 9) -> DataFrame:
    """R26 contracts, value and non-competitive marker per modality."""
    g = (c.groupBy(F.col("modalidad_de_contratacion").alias("m"))
          .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("valor"),
               F.bool_or("es_sin_competencia").alias("sin_comp")))
    return (g.orderBy(F.desc("valor"), F.asc_nulls_last("m")).limit(top)
             .withColumn("v", bn("valor", 1)))


def department_weeks(c: DataFrame) -> DataFrame:
    return (c.groupBy("departamento", F.trunc(F.to_date("fecha_de_firma"), "week").alias("semana"))
             .agg(F.count(F.lit(1)).alias("n")))


def peak_week(c: DataFrame) -> DataFrame:
    """R28 peak week per department (earliest week among equal peaks)."""
    w = Window.partitionBy("departamento").orderBy(F.desc("n"), F.asc("semana"))
    return (department_weeks(c).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def share_of_max(c: DataFrame) -> DataFrame:
    """R28 each week's contracts as a share of the department's peak."""
    w = Window.partitionBy("departamento")
    return department_weeks(c).withColumn("share", F.col("n") / F.max("n").over(w))


# ------------------------------------------------------------- catalogue ---

def _c(ctx: Context) -> DataFrame:
    return ctx.contracts(DEFAULT, TEST)


def wa(body: str) -> str:
    return f"WITH {alerts_cte()}\n{body}"


@register("r07_kpi", with_ctes(f"""
SELECT count(*) AS contratos, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor_total,
  CAST(sum(CASE WHEN es_sin_competencia THEN valor_del_contrato END) AS DOUBLE) AS valor_sin_competencia,
  round(100.0 * CAST(coalesce(sum(CASE WHEN es_sin_competencia THEN valor_del_contrato END), 0) AS DOUBLE)
        / CAST(sum(valor_del_contrato) AS DOUBLE)) AS pct_sin_competencia,
  count(DISTINCT nit_entidad) AS entidades, count(DISTINCT documento_proveedor) AS proveedores,
  CAST(CAST(min(fecha_de_firma) AS DATE) AS VARCHAR) AS desde,
  CAST(CAST(max(fecha_de_firma) AS DATE) AS VARCHAR) AS hasta
FROM {CC}"""))
def r07(ctx):
    """R7 national KPIs."""
    return kpi(_c(ctx))


@register("r08_alert_kpi", wa("SELECT count(*) AS n, CAST(sum(valor_cop) AS DOUBLE) AS v FROM alertas"))
def r08(ctx):
    """R8 alert KPIs."""
    return alert_kpi(alerts_df(ctx))


def _top_sql(key: str, label: str, named_only: bool) -> str:
    where = "WHERE label IS NOT NULL" if named_only else ""
    return wa(f"""
SELECT key, label AS nombre, score, n_alertas AS alertas, {O.rnd(O.dbl('valor_bajo_alerta') + ' / 1e9', 1)} AS v
FROM (SELECT {key} AS key, max({label}) AS label, CAST(least(100, sum(severidad)) AS INTEGER) AS score,
             count(*) AS n_alertas, sum(valor_cop) AS valor_bajo_alerta
      FROM alertas WHERE {key} IS NOT NULL GROUP BY {key}) s
{where}
ORDER BY score DESC, valor_bajo_alerta DESC, key ASC LIMIT 10""")


@register("r09_top_entities", _top_sql("nit_entidad", "nombre_entidad", False))
def r09(ctx):
    """R9 top buyers by score."""
    return top_scores(S.entity_scores(alerts_df(ctx)), 10)


@register("r10_top_suppliers", _top_sql("documento_proveedor", "proveedor", True))
def r10(ctx):
    """R10 top suppliers by score (named only, as exported)."""
    return top_scores(S.supplier_scores(alerts_df(ctx)), 10, named_only=True)


# departments of every buyer namespace used by the alert table
GEO_BINDINGS = [NATION_SUPPLIER, CUSTOMER_SUPPLIER]


def _dims(ctx: Context, fn) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [fn(ctx.contracts(b, TEST)) for b in GEO_BINDINGS])


def _dims_sql(modal: bool) -> str:
    parts = []
    for b in GEO_BINDINGS:
        cc = O.cte_name(b)
        if modal:
            parts.append(f"""SELECT nit_entidad, departamento FROM (
  SELECT nit_entidad, departamento, row_number() OVER (PARTITION BY nit_entidad ORDER BY n DESC, departamento ASC) AS rn
  FROM (SELECT nit_entidad, departamento, count(*) AS n FROM {cc}
        WHERE nit_entidad IS NOT NULL AND departamento IS NOT NULL GROUP BY ALL)) WHERE rn = 1""")
        else:
            parts.append(f"SELECT DISTINCT nit_entidad, departamento FROM {cc} WHERE nit_entidad IS NOT NULL")
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def _geo_sql(modal: bool) -> str:
    return wa(f"""
SELECT departamento AS d, CAST(sum(a.valor_cop) AS DOUBLE) AS valor,
       {O.rnd(O.dbl('sum(a.valor_cop)') + ' / 1e9', 1)} AS v
FROM alertas a JOIN ({_dims_sql(modal)}) c ON a.nit_entidad = c.nit_entidad
WHERE c.departamento IS NOT NULL
GROUP BY departamento ORDER BY sum(a.valor_cop) DESC, departamento ASC LIMIT 12""")


@register("r11_geo_fanout", _geo_sql(False))
def r11f(ctx):
    """R11 value under alert per department, fan-out join (published)."""
    return geography(alerts_df(ctx), _dims(ctx, entity_departments))


@register("r11_geo_modal", _geo_sql(True))
def r11m(ctx):
    """R11 value under alert per department, one department per buyer."""
    return geography(alerts_df(ctx), _dims(ctx, modal_departments))


@register("r12_flag_labels", wa("SELECT DISTINCT codigo || ': ' || bandera AS b FROM alertas"))
def r12(ctx):
    """R12 flag label list."""
    return flag_labels(alerts_df(ctx))


_ORDER_SQL = ("severidad DESC, valor_cop DESC, codigo ASC, nit_entidad ASC NULLS LAST, "
              "documento_proveedor ASC NULLS LAST, id_contrato ASC NULLS LAST, anio ASC NULLS LAST, "
              "detalle ASC NULLS LAST")
FEED_CODES = ["F01", "F04", "F09"]


@register("r13_feed", wa(f"""
SELECT codigo, bandera, coalesce(nombre_entidad, '') AS entidad, coalesce(proveedor, '') AS contratista,
       detalle, {O.rnd(O.dbl('valor_cop') + ' / 1e6', 1)} AS valor_m, severidad
FROM alertas WHERE codigo IN ({', '.join(O.q(c) for c in FEED_CODES)})
ORDER BY {_ORDER_SQL} LIMIT 500"""))
def r13(ctx):
    """R13 alert feed for selected flags, top 500."""
    return alert_feed(alerts_df(ctx), FEED_CODES, 500)


@register("r14_top_alerts", wa(f"""
SELECT codigo, bandera, coalesce(nombre_entidad, '') AS entidad, coalesce(proveedor, '') AS contratista,
       detalle, {O.rnd(O.dbl('valor_cop') + ' / 1e9', 2)} AS v
FROM alertas ORDER BY {_ORDER_SQL} LIMIT 12"""))
def r14(ctx):
    """R14 twelve most severe alerts."""
    return top_alerts(alerts_df(ctx), 12)


@register("r23_daily", with_ctes(f"""
SELECT CAST(CAST(fecha_de_firma AS DATE) AS VARCHAR) AS dia, count(*) AS contratos,
       CAST(sum(valor_del_contrato) AS DOUBLE) AS valor
FROM {CC} GROUP BY 1"""))
def r23(ctx):
    """R23 daily series."""
    return daily(_c(ctx))


@register("r24_weekly", with_ctes(f"""
SELECT CAST(CAST(date_trunc('week', fecha_de_firma) AS DATE) AS VARCHAR) AS d, count(*) AS n,
       CAST(sum(valor_del_contrato) AS DOUBLE) AS valor,
       {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 2)} AS v
FROM {CC} GROUP BY 1"""))
def r24(ctx):
    """R24 weekly series (Monday weeks)."""
    return weekly(_c(ctx))


@register("r25_month_modality", with_ctes(f"""
SELECT CAST(g.mes AS VARCHAR) AS mes, g.modalidad, CAST(g.valor AS DOUBLE) AS valor FROM g
WHERE EXISTS (SELECT 1 FROM (SELECT modalidad, sum(valor) AS t FROM g GROUP BY 1
                             ORDER BY t DESC, modalidad ASC NULLS LAST LIMIT 6) top
              WHERE top.modalidad IS NOT DISTINCT FROM g.modalidad)""", [DEFAULT], f"""g AS (
  SELECT mes_firma AS mes, modalidad_de_contratacion AS modalidad, sum(valor_del_contrato) AS valor
  FROM {CC} GROUP BY 1, 2 HAVING sum(valor_del_contrato) > 0)"""))
def r25(ctx):
    """R25 monthly value by modality, top-6 modalities (semi-join)."""
    return month_modality(_c(ctx), 6)


@register("r26_modality", with_ctes(f"""
SELECT modalidad_de_contratacion AS m, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor,
       bool_or(es_sin_competencia) AS sin_comp, {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 1)} AS v
FROM {CC} GROUP BY 1 ORDER BY sum(valor_del_contrato) DESC, m ASC NULLS LAST LIMIT 9"""))
def r26(ctx):
    """R26 modality totals, top 9."""
    return modality_totals(_c(ctx), 9)


_DW = (f"(SELECT departamento, CAST(date_trunc('week', fecha_de_firma) AS DATE) AS semana, count(*) AS n"
       f" FROM {CC} GROUP BY 1, 2)")


@register("r28_peak", with_ctes(f"""
SELECT departamento, CAST(semana AS VARCHAR) AS semana, n FROM (
  SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY n DESC, semana ASC) AS rn FROM {_DW})
WHERE rn = 1"""))
def r28p(ctx):
    """R28 peak week per department."""
    return peak_week(_c(ctx))


@register("r28_share_of_max", with_ctes(f"""
SELECT departamento, CAST(semana AS VARCHAR) AS semana, n,
       n / max(n) OVER (PARTITION BY departamento) AS share FROM {_DW}"""))
def r28s(ctx):
    """R28 weekly contracts as share of the department's peak."""
    return share_of_max(_c(ctx))
