"""Catalogue entries: sources, sinks and cleaning.

Round-trip entries write to a fresh folder under the shared checkpoint
directory and read the files back, so the scan path is what is checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.functions.text import clean_entity_name, clean_id, clean_supplier_name
from veeduria.operators.derive import derive
from veeduria.operators.normalize import DEDUPE_ORDER, coerce, dedupe, normalize
from veeduria.operators import scores as S
from veeduria.plans import oracle as O
from veeduria.plans import reports as R
from veeduria.plans.catalog import DEFAULT, TEST, alerts_df, register, with_alerts, with_ctes
from veeduria.plans.context import Context
from veeduria.plans.profiles import ENTITY
from veeduria.schema import ALERT, CONTRACT_COLUMNS, DATE_COLUMNS
from veeduria.session import scratch_table_dir
from veeduria.sources import landed as L
from veeduria.sources import sinks as K

CC = O.cte_name(DEFAULT)
RAW = f"raw_{DEFAULT.name}"


def _scratch(ctx: Context, name: str) -> str:
    return scratch_table_dir(ctx.spark, f"{name}_{uuid.uuid4().hex[:10]}")


def landed_text(raw: DataFrame) -> DataFrame:
    """Bound records as the portal serves them: every value text, ISO dates
    with a 'T', names and ids with stray blanks, tabs and asterisks."""
    out = []
    for c in CONTRACT_COLUMNS:
        col = F.col(c)
        if c in DATE_COLUMNS:
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        elif c == "nombre_entidad":
            col = F.concat(F.lit(" "), col, F.lit("** "))
        elif c == "proveedor_adjudicado":
            col = F.concat(F.lit("\t"), F.lower(col), F.lit(" "))
        elif c in ("nit_entidad", "documento_proveedor"):
            col = F.concat(F.lit(" "), col, F.lit(" "))
        else:
            col = col.cast("string")
        out.append(col.alias(c))
    return raw.select(*out)


KEEP = ["id_contrato", "nit_entidad", "documento_proveedor", "nombre_entidad", "proveedor_adjudicado",
        "valor_del_contrato", "fecha_de_firma", "dias_adicionados", "anio", "es_sin_competencia"]


def _keep_sql(src: str, money_scale: int | None = None) -> str:
    v = "valor_del_contrato" if money_scale is None else f"CAST(valor_del_contrato AS DECIMAL(20,{money_scale}))"
    return (f"SELECT id_contrato, nit_entidad, documento_proveedor, nombre_entidad, proveedor_adjudicado,"
            f" CAST({v} AS DOUBLE) AS valor_del_contrato, CAST(fecha_de_firma AS VARCHAR) AS fecha_de_firma,"
            f" dias_adicionados, anio, es_sin_competencia FROM {src}")


@register("s01_landed_json", with_ctes(_keep_sql(CC, 2)))
def s01(ctx: Context):
    """Landed JSON text scanned with the fixed schema, then
    coerced, cleaned and derived."""
    path = _scratch(ctx, "landed")
    K.write_json(landed_text(ctx.raw_contracts(DEFAULT)), path)
    c = derive(normalize(L.read_landed_json(ctx.spark, path)), TEST)
    return c.select(*KEEP)


@register("s04_windows", with_ctes(f"""
SELECT CAST(greatest(m, lo) AS VARCHAR) AS start, CAST(CAST(m + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS "end"
FROM (SELECT lo, CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP),
                                             CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m
      FROM (SELECT DATE '1995-03-17' AS lo, CAST(max(fecha_de_firma) AS DATE) AS hi FROM {CC}))"""))
def s04(ctx: Context):
    """S4 half-open month windows from a mid-month date to the last data month."""
    return L.month_windows(ctx.contracts(DEFAULT, TEST), desde="1995-03-17")


@register("s05_range", with_ctes(f"""
SELECT id_contrato, CAST(fecha_de_firma AS VARCHAR) AS fecha_de_firma, CAST(valor_del_contrato AS DOUBLE) AS valor,
       documento_proveedor FROM {CC}
WHERE fecha_de_firma >= TIMESTAMP '2000-01-01' AND fecha_de_firma < TIMESTAMP '2000-03-01'"""))
def s05(ctx: Context):
    """S5 one dated window [2000-01-01, 2000-03-01)."""
    c = L.date_range(ctx.contracts(DEFAULT, TEST), "2000-01-01", "2000-03-01")
    return c.select("id_contrato", "fecha_de_firma", F.col("valor_del_contrato").alias("valor"),
                    "documento_proveedor")


@register("s06_latest", with_ctes(f"""
SELECT id_contrato, CAST(fecha_de_firma AS VARCHAR) AS fecha_de_firma, CAST(valor_del_contrato AS DOUBLE) AS valor,
       documento_proveedor FROM {CC}
ORDER BY fecha_de_firma DESC NULLS LAST, id_contrato ASC, valor_del_contrato DESC,
         documento_proveedor ASC NULLS LAST LIMIT 100"""))
def s06(ctx: Context):
    """S6 latest 100 contracts."""
    c = L.latest(ctx.contracts(DEFAULT, TEST), 100)
    return c.select("id_contrato", "fecha_de_firma", F.col("valor_del_contrato").alias("valor"),
                    "documento_proveedor")


ALERT_SQL = ("SELECT codigo, bandera, nivel, nombre_entidad, nit_entidad, proveedor, documento_proveedor, "
             "id_contrato, anio, detalle, CAST(valor_cop AS DOUBLE) AS valor_cop, severidad FROM alertas")


@register("s11_csv", with_alerts(ALERT_SQL))
def s11(ctx: Context):
    """S11 alert table through a CSV export and back."""
    path = _scratch(ctx, "alerts_csv")
    K.write_csv(alerts_df(ctx), path, "gzip")
    return K.read_csv(ctx.spark, path, ALERT)


_DESC_SQL = ", ".join(f"({O.q(k)}, {O.q(v)})" for k, v in sorted(__import__("veeduria.params", fromlist=["x"]).FLAG_DESCRIPTIONS.items()))


@register("s12_json", with_alerts(
    f"SELECT s.*, d.descripcion FROM (SELECT codigo, max(bandera) AS bandera, count(*) AS n,"
    f" CAST(sum(valor_cop) AS DOUBLE) AS valor, {O.rnd(O.dbl('sum(valor_cop)') + ' / 1e9', 1)} AS v"
    f" FROM alertas GROUP BY codigo) s LEFT JOIN (VALUES {_DESC_SQL}) d(codigo, descripcion) USING (codigo)"))
def s12(ctx: Context):
    """S12 JSON bundle (KPIs + flag summary) written as one document and
    read back; the flag section is returned."""
    a = alerts_df(ctx)
    summary = S.flag_summary(a)
    kpi = R.kpi(ctx.contracts(DEFAULT, TEST))
    path = _scratch(ctx, "bundle")
    K.json_bundle({"kpi": (kpi, [F.asc("contratos")]), "banderas": (summary, [F.asc("codigo")])}).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("kpi", T.ArrayType(kpi.schema)),
                           T.StructField("banderas", T.ArrayType(summary.schema))])
    back = ctx.spark.read.schema(schema).json(path)
    return back.select(F.explode("banderas").alias("b")).select("b.*")


@register("s13_dossier_json", __import__("veeduria.plans.dossier_q", fromlist=["x"])._sql(15, None, "keys"))
def s13(ctx: Context):
    """S13 nested dossiers (array of evidence structs) through JSON and back."""
    from veeduria.plans.dossier_q import build
    flat = build(ctx, 15, None, "keys")
    ev_cols = ["ev_rank", "id_contrato", "proceso_de_compra", "firma", "nombre_entidad",
               "proveedor_adjudicado", "modalidad", "millones", "dias_adicionados", "objeto"]
    keys = ["rank", "codigo", "bandera", "a_entidad", "a_proveedor", "a_anio", "detalle", "valor_cop", "severidad"]
    nested = flat.groupBy(*keys).agg(F.collect_list(F.struct(*ev_cols)).alias("contratos"))
    path = _scratch(ctx, "dossier_json")
    K.write_json(nested, path)
    back = ctx.spark.read.schema(nested.schema).json(path)
    return back.select(*keys, F.explode("contratos").alias("e")).select(*keys, "e.*")


@register("s14_count", with_ctes(f"SELECT count(*) AS n FROM {CC}"))
def s14(ctx: Context):
    """S14 rows loaded."""
    return L.load_count(ctx.contracts(DEFAULT, TEST))


@register("s15_params", with_ctes(f"""
SELECT count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS v FROM {CC} WHERE nombre_entidad = {O.q(ENTITY)}"""))
def s15(ctx: Context):
    """S15 parameterised SQL (named marker bound as a literal)."""
    ctx.contracts(DEFAULT, TEST).createOrReplaceTempView("contratos_clean")
    out = L.sql(ctx.spark, "SELECT count(*) AS n, sum(valor_del_contrato) AS v FROM contratos_clean "
                           "WHERE nombre_entidad = :ent", ent=ENTITY)
    return out


@register("n02_coerce", with_ctes(f"""
SELECT id_contrato, CAST(TRY_CAST(CAST(valor_del_contrato AS VARCHAR) AS DECIMAL(20,2)) AS DOUBLE) AS valor_del_contrato,
  CAST(TRY_CAST(strftime(fecha_de_firma, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS VARCHAR) AS fecha_de_firma,
  TRY_CAST(CAST(dias_adicionados AS VARCHAR) AS INTEGER) AS dias_adicionados FROM {RAW}"""))
def n02(ctx: Context):
    """N2/N3 text to decimal(20,2), timestamp and int; bad text -> NULL."""
    raw = landed_text(ctx.raw_contracts(DEFAULT))
    return coerce(raw).select("id_contrato", "valor_del_contrato", "fecha_de_firma", "dias_adicionados")


@register("n04_ids", with_ctes(f"""
SELECT DISTINCT ' ' || nit_entidad || chr(9) AS raw, {O.clean_id("' ' || nit_entidad || chr(9)")} AS clean FROM {RAW}
UNION ALL
SELECT DISTINCT ' ' || documento_proveedor || chr(9) AS raw, {O.clean_id("' ' || documento_proveedor || chr(9)")} AS clean
FROM {RAW}"""))
def n04(ctx: Context):
    """N4/N5 identity numbers: strip, drop check digit."""
    raw = ctx.raw_contracts(DEFAULT)
    parts = []
    for c in ("nit_entidad", "documento_proveedor"):
        r = F.concat(F.lit(" "), F.col(c), F.lit("\t"))
        parts.append(raw.select(r.alias("raw")).distinct().select("raw", clean_id("raw").alias("clean")))
    return parts[0].unionByName(parts[1])


@register("n06_names", with_ctes(f"""
SELECT DISTINCT ' ' || nombre_entidad || '** ' AS raw,
  NULLIF(upper(rtrim({O.strip("' ' || nombre_entidad || '** '")}, '*')), '') AS clean, 'entidad' AS kind
FROM {RAW}
UNION ALL
SELECT DISTINCT chr(9) || lower(proveedor_adjudicado) || ' ' AS raw,
  NULLIF(upper({O.strip("chr(9) || lower(proveedor_adjudicado) || ' '")}), '') AS clean, 'proveedor' AS kind FROM {RAW}"""))
def n06(ctx: Context):
    """N6/N7 names: strip, trailing '*', upper case."""
    raw = ctx.raw_contracts(DEFAULT)
    e = raw.select(F.concat(F.lit(" "), F.col("nombre_entidad"), F.lit("** ")).alias("raw")).distinct()
    s = raw.select(F.concat(F.lit("\t"), F.lower("proveedor_adjudicado"), F.lit(" ")).alias("raw")).distinct()
    return (e.select("raw", clean_entity_name("raw").alias("clean"), F.lit("entidad").alias("kind"))
             .unionByName(s.select("raw", clean_supplier_name("raw").alias("clean"), F.lit("proveedor").alias("kind"))))


_DD_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in DEDUPE_ORDER)


@register("n08_dedupe", with_ctes(f"""
SELECT id_contrato, CAST(fecha_de_firma AS VARCHAR) AS fecha_de_firma, CAST(valor_del_contrato AS DOUBLE) AS valor,
       documento_proveedor FROM (
  SELECT *, row_number() OVER (PARTITION BY id_contrato ORDER BY {_DD_ORDER}) AS rn FROM norm_{DEFAULT.name})
WHERE (rn = 1 OR id_contrato IS NULL) AND valor_del_contrato IS NOT NULL AND valor_del_contrato > 0
  AND fecha_de_firma IS NOT NULL"""))
def n08(ctx: Context):
    """N8 one row per contract id (latest, then largest)."""
    c = derive(dedupe(ctx.normalized(DEFAULT)), TEST)
    return c.select("id_contrato", "fecha_de_firma", F.col("valor_del_contrato").alias("valor"),
                    "documento_proveedor")
