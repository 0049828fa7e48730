"""Report forms beside those of ``reports``: the national peak and the share
of the largest department (R28, T4), geography with buyers of no department
(R11), the non-competitive share of a buyer (R16), awards by regime and level
(R31), dossier headings with formatted numbers, the whole JSON bundle (S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.functions.fmt import bn, millions, padded, round_half, thousands
from veeduria.operators import scores as S
from veeduria.plans import oracle as O
from veeduria.plans import reports as R
from veeduria.plans.catalog import DEFAULT, TEST, alerts_df, register, with_alerts, with_ctes
from veeduria.plans.context import Context
from veeduria.plans.profiles import ENTITY, entity_summary
from veeduria.session import reuse, scratch_table_dir
from veeduria.sources import sinks as K

CC = O.cte_name(DEFAULT)


def _c(ctx: Context) -> DataFrame:
    return ctx.contracts(DEFAULT, TEST)


# ------------------------------------------------------------ operators ---
def national_peak(c: DataFrame) -> DataFrame:
    """T4/R28 the busiest week of the country (the earliest of equal ones)
    and the ends of the series: one aggregate over the weeks."""
    w = R.weekly(c)
    first = F.unix_date("d")
    return (w.agg(F.min("d").alias("desde"), F.max("d").alias("hasta"), F.count(F.lit(1)).alias("semanas"),
                  F.max_by(F.struct("d", "n", "v"), F.struct("n", -first)).alias("p"))
             .where(F.col("p").isNotNull())
             .select("desde", "hasta", "semanas", F.col("p.d").alias("pico"), F.col("p.n").alias("n"), F.col("p.v").alias("v")))


def departments_of_largest(a: DataFrame, dims: DataFrame, n: int = 12) -> DataFrame:
    """R28 each listed department's value as a percentage of the largest one
    (of the published values; the list has ``n`` rows, written once for the
    list and its largest value)."""
    g = reuse(R.geography(a, dims, n))
    top = g.agg(F.max("v").alias("m")).select("m").scalar()
    return g.select("d", "v", round_half(F.lit(100.0) * F.col("v") / F.when(top != 0, top), 1).alias("pct"))


def geography_all(a: DataFrame, dims: DataFrame, n: int = 20) -> DataFrame:
    """R11 as the dashboard has it: buyers without a department are a row."""
    g = R.value_by_buyer(a).join(dims, "nit_entidad").groupBy("departamento").agg(F.sum("valor_cop").alias("valor"))
    return g.orderBy(F.desc("valor"), F.asc_nulls_last("departamento")).limit(n)


def entity_share(c: DataFrame, name: str) -> DataFrame:
    """R16 with the share of value awarded without competition, in whole
    percent."""
    pct = F.lit(100.0) * F.coalesce("vd", F.lit(0)).cast("double") / F.col("v").cast("double")
    return entity_summary(c, name).withColumn("pct_sin_competencia", round_half(pct, 0))


def by_regime(c: DataFrame, direct: list[str], special: list[str]) -> DataFrame:
    """R31 contracts of a period by regime (direct award, special regime,
    competition) and buyers' level, with their share of all."""
    def any_of(patterns):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.coalesce(F.col("modalidad_de_contratacion").ilike(p), F.lit(False))
        return hit
    regime = F.when(any_of(direct), "directa").when(any_of(special), "especial").otherwise("competencia")
    g = (c.groupBy(regime.alias("regimen"), F.coalesce("orden", F.lit("")).alias("orden"))
          .agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").alias("valor")))
    total = g.agg(F.sum("n").alias("t")).select("t").scalar()
    return g.withColumn("pct", round_half(F.lit(100.0) * F.col("n") / total, 1))


def dossier_headings(a: DataFrame, n: int = 15) -> DataFrame:
    """Numbered headings of the dossiers: '## Expediente 01 · F01 · name', the
    value in millions with commas, the severity out of 100."""
    top = a.orderBy(*R._alert_order()).limit(n)
    placed = top.withColumn("i", F.row_number().over(Window.orderBy(*R._alert_order())))      # of n rows
    return placed.select(
        "i", F.concat(F.lit("## Expediente "), padded("i", 2), F.lit(" · "), "codigo", F.lit(" · "), "bandera").alias("titulo"),
        F.concat(F.lit("$"), thousands(millions("valor_cop")), F.lit(" millones COP · severidad "),
                 F.col("severidad").cast("string"), F.lit("/100")).alias("valor"))


# ------------------------------------------------------------- catalogue ---
_WEEKS = (f"(SELECT CAST(date_trunc('week', fecha_de_firma) AS DATE) AS d, count(*) AS n,"
          f" {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 2)} AS v FROM {CC} GROUP BY 1)")


@register("r28_national_peak", with_ctes(f"""
SELECT CAST(lo AS VARCHAR) AS desde, CAST(hi AS VARCHAR) AS hasta, semanas, CAST(d AS VARCHAR) AS pico, n, v FROM (
  SELECT *, min(d) OVER () AS lo, max(d) OVER () AS hi, count(*) OVER () AS semanas,
         row_number() OVER (ORDER BY n DESC, d) AS rn FROM {_WEEKS}) WHERE rn = 1"""))
def r28_national(ctx: Context):
    """T4/R28 national peak week."""
    return national_peak(_c(ctx))


_GEO = R._geo_sql(False)


@register("r28_departments", f"SELECT d, v, {O.rnd('100.0::DOUBLE * v / max(v) OVER ()', 1)} AS pct FROM ({_GEO})")
def r28_departments(ctx: Context):
    """R28 departments as percentages of the largest."""
    return departments_of_largest(alerts_df(ctx), R._dims(ctx, R.entity_departments))


@register("r11_geo_all", with_alerts(f"""
SELECT departamento, CAST(sum(a.valor_cop) AS DOUBLE) AS valor
FROM alertas a JOIN ({R._dims_sql(False)}) c ON a.nit_entidad = c.nit_entidad
GROUP BY departamento ORDER BY sum(a.valor_cop) DESC, departamento ASC NULLS LAST LIMIT 20"""))
def r11_all(ctx: Context):
    """R11 value under alert per department, NULL kept, top 20."""
    return geography_all(alerts_df(ctx), R._dims(ctx, R.entity_departments))


@register("r16_entity_share", with_ctes(f"""
SELECT n, CAST(v AS DOUBLE) AS v, CAST(vd AS DOUBLE) AS vd, provs,
       round(100.0::DOUBLE * CAST(coalesce(vd, 0) AS DOUBLE) / CAST(v AS DOUBLE)) AS pct_sin_competencia
FROM (SELECT count(*) AS n, sum(valor_del_contrato) AS v, count(DISTINCT documento_proveedor) AS provs,
             sum(CASE WHEN es_sin_competencia THEN valor_del_contrato END) AS vd
      FROM {CC} WHERE nombre_entidad = {O.q(ENTITY)})"""))
def r16_share(ctx: Context):
    """R16 buyer summary with the non-competitive percentage."""
    return entity_share(_c(ctx), ENTITY)


@register("r31_regime", with_ctes(f"""
SELECT *, {O.rnd('100.0::DOUBLE * n / sum(n) OVER ()', 1)} AS pct FROM (
  SELECT CASE WHEN modalidad_de_contratacion ILIKE '1-URGENT' THEN 'directa'
              WHEN modalidad_de_contratacion ILIKE '2-HIGH' THEN 'especial' ELSE 'competencia' END AS regimen,
         coalesce(orden, '') AS orden, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor
  FROM {CC} WHERE anio = 1998 AND mes = 1 GROUP BY 1, 2)"""))
def r31_regime(ctx: Context):
    """R31 awards of a January by regime and level."""
    c = _c(ctx).where((F.col("anio") == 1998) & (F.col("mes") == 1))
    return by_regime(c, ["1-URGENT"], ["2-HIGH"])


_MM = "CAST(round(valor_cop / 1000000) AS BIGINT)"


@register("r27_headings", with_alerts(f"""
SELECT CAST(row_number() OVER (ORDER BY {R._ORDER_SQL}) AS INTEGER) AS i,
  '## Expediente ' || lpad(CAST(row_number() OVER (ORDER BY {R._ORDER_SQL}) AS VARCHAR), 2, '0') || ' · ' || codigo
    || ' · ' || bandera AS titulo,
  '$' || format('{{:,}}', {_MM}) || ' millones COP · severidad ' || CAST(severidad AS VARCHAR) || '/100' AS valor
FROM alertas ORDER BY {R._ORDER_SQL} LIMIT 15"""))
def r27_headings(ctx: Context):
    """R27 dossier headings: numbers padded with zeros and with thousands."""
    return dossier_headings(alerts_df(ctx), 15)


# ---------------------------------------------------------------- bundle ---
def bundle_sections(ctx: Context) -> dict:
    """S12 the nine sections in the published order, each with its order."""
    a = reuse(alerts_df(ctx))  # seven sections read it; first: it keeps the star join, which the contracts are then read from
    c = _c(ctx)
    k = R.kpi(c).crossJoin(R.alert_kpi(a).select(F.col("n").alias("alertas"), F.col("v").alias("valor_alerta")))  # 1 x 1 rows
    today = c.agg(F.to_date(F.max("fecha_de_firma")).alias("fecha"))
    geo = R.geography(a, R._dims(ctx, R.entity_departments))
    flags = S.flag_summary(a).select("codigo", "bandera", "n", "v", "descripcion")
    place = [F.desc("score"), F.desc("valor"), F.asc("key")]

    def top(scores, named):
        s = scores.where(F.col("label").isNotNull()) if named else scores
        s = s.select("key", F.col("label").alias("nombre"), F.col("score").cast("long").alias("score"),
                     F.col("n_alertas").alias("alertas"), F.col("valor_bajo_alerta").alias("valor"),
                     bn("valor_bajo_alerta", 1).alias("v"))
        return s.orderBy(*place).limit(10)
    alerts = a.orderBy(*R._alert_order()).limit(12).select(*a.columns, bn("valor_cop", 2).alias("v"))
    return {
        "generado": (today, [F.asc("fecha")]), "kpi": (k, [F.asc("contratos")]),
        "serie_diaria": (R.weekly(c).select("d", "n", "v"), [F.asc("d")]),
        "modalidades": (R.modality_totals(c), [F.desc("valor"), F.asc_nulls_last("m")]),
        "banderas": (flags, [F.asc("codigo")]),
        "top_entidades": (top(S.entity_scores(a), False), place),
        "top_contratistas": (top(S.supplier_scores(a), True), place),
        "departamentos": (geo, [F.desc("valor"), F.asc("d")]),
        "alertas_top": (alerts, R._alert_order()),
    }


_ITEM = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("fecha", T.StringType()), ("d", T.StringType()), ("m", T.StringType()), ("nombre", T.StringType()),
    ("codigo", T.StringType()), ("detalle", T.StringType()), ("contratos", T.LongType()), ("n", T.LongType()),
    ("score", T.LongType()), ("alertas", T.LongType()), ("v", T.DoubleType()), ("valor_alerta", T.DoubleType()))]))


def _top_rows(key: str, label: str, named: bool) -> str:
    return f"""(SELECT *, row_number() OVER (ORDER BY score DESC, val DESC, key) AS orden FROM (
  SELECT {key} AS key, max({label}) AS nombre, CAST(least(100, sum(severidad)) AS BIGINT) AS score, sum(valor_cop) AS val
  FROM alertas WHERE {key} IS NOT NULL GROUP BY 1 {f'HAVING max({label}) IS NOT NULL' if named else ''}))"""


@register("s12_bundle", with_alerts(f"""
SELECT 'generado' AS seccion, 1::BIGINT AS orden, CAST(CAST(max(fecha_de_firma) AS DATE) AS VARCHAR) AS clave,
       NULL::BIGINT AS n, NULL::DOUBLE AS v FROM {CC}
UNION ALL SELECT 'kpi', 1, NULL, (SELECT count(*) FROM {CC}), (SELECT CAST(sum(valor_cop) AS DOUBLE) FROM alertas)
UNION ALL SELECT 'serie_diaria', row_number() OVER (ORDER BY d), CAST(d AS VARCHAR), n, v FROM {_WEEKS}
UNION ALL SELECT 'modalidades', orden, m, n, v FROM (
  SELECT modalidad_de_contratacion AS m, count(*) AS n, {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 1)} AS v,
         row_number() OVER (ORDER BY sum(valor_del_contrato) DESC, modalidad_de_contratacion NULLS LAST) AS orden
  FROM {CC} GROUP BY 1) WHERE orden <= 9
UNION ALL SELECT 'banderas', row_number() OVER (ORDER BY codigo), codigo, count(*),
  {O.rnd(O.dbl('sum(valor_cop)') + ' / 1e9', 1)} FROM alertas GROUP BY codigo
UNION ALL SELECT 'top_entidades', orden, nombre, score, {O.rnd(O.dbl('val') + ' / 1e9', 1)}
  FROM {_top_rows('nit_entidad', 'nombre_entidad', False)} WHERE orden <= 10
UNION ALL SELECT 'top_contratistas', orden, nombre, score, {O.rnd(O.dbl('val') + ' / 1e9', 1)}
  FROM {_top_rows('documento_proveedor', 'proveedor', True)} WHERE orden <= 10
UNION ALL SELECT 'departamentos', row_number() OVER (ORDER BY valor DESC, d), d, NULL, v FROM (
  SELECT departamento AS d, sum(a.valor_cop) AS valor, {O.rnd(O.dbl('sum(a.valor_cop)') + ' / 1e9', 1)} AS v
  FROM alertas a JOIN ({R._dims_sql(False)}) c ON a.nit_entidad = c.nit_entidad WHERE departamento IS NOT NULL
  GROUP BY 1 ORDER BY valor DESC, d LIMIT 12)
UNION ALL SELECT 'alertas_top', row_number() OVER (ORDER BY {R._ORDER_SQL}), codigo || ' ' || detalle, NULL, v FROM (
  SELECT *, {O.rnd(O.dbl('valor_cop') + ' / 1e9', 2)} AS v FROM alertas ORDER BY {R._ORDER_SQL} LIMIT 12)"""))
def s12_bundle(ctx: Context):
    """S12 the whole JSON bundle, written as one document and read back: every
    row of every section with its place."""
    sections = bundle_sections(ctx)
    path = scratch_table_dir(ctx.spark, f"bundle_{uuid.uuid4().hex[:10]}")
    K.json_bundle(sections).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField(s, _ITEM) for s in sections])
    back = ctx.spark.read.schema(schema).json(path)
    named = F.array(*[F.struct(F.lit(s).alias("seccion"), F.col(s).alias("filas")) for s in sections])
    rows = (back.select(F.explode(named).alias("s")).select("s.seccion", F.posexplode("s.filas").alias("p", "r"))
                .select("seccion", (F.col("p") + 1).cast("long").alias("orden"), "r.*"))
    key = (F.when(F.col("seccion") == "alertas_top", F.concat_ws(" ", "codigo", "detalle"))
            .otherwise(F.coalesce("fecha", "nombre", "codigo", "m", "d")))
    plain = ~F.col("seccion").isin("departamentos", "alertas_top")
    return rows.select("seccion", "orden", key.alias("clave"),
                       F.when(plain, F.coalesce("contratos", "score", "n")).alias("n"),
                       F.when(F.col("seccion") == "kpi", F.col("valor_alerta")).otherwise(F.col("v")).alias("v"))
