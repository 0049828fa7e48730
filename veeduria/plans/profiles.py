"""Buyer and supplier profiles and supplier search.

Each profile is a filter on a key (pushed to the Parquet scan of a
materialised contract table) followed by a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.functions.fmt import bn, mm
from veeduria.plans import oracle as O
from veeduria.plans.catalog import DEFAULT, TEST, alerts_cte, alerts_df, register, with_ctes
from veeduria.plans.context import Context


def _v():
    """The contract value column."""
    return F.col("valor_del_contrato")


CC = O.cte_name(DEFAULT)

# Catalogue arguments: a buyer name and a supplier id present at every scale.
ENTITY = "NATION_7"
SUPPLIER_DOC = "S1"
SEARCH = "plier#00000001"


def entity_list(c: DataFrame) -> DataFrame:
    """R15 distinct buyer names."""
    return c.select("nombre_entidad").distinct()


def entity_summary(c: DataFrame, name: str) -> DataFrame:
    """R16 contracts, value, non-competitive value and suppliers of a buyer."""
    e = c.where(F.col("nombre_entidad") == F.lit(name))
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("v"),
                 F.sum(F.when(F.col("es_sin_competencia"), _v())).alias("vd"),
                 F.countDistinct("documento_proveedor").alias("provs"))


def entity_modalities(c: DataFrame, name: str) -> DataFrame:
    """R17 value by modality for a buyer."""
    return (c.where(F.col("nombre_entidad") == F.lit(name))
             .groupBy(F.col("modalidad_de_contratacion").alias("m"))
             .agg(F.sum(_v()).alias("valor")).withColumn("v", bn("valor", 3)))


def entity_top_suppliers(c: DataFrame, name: str, n: int = 10) -> DataFrame:
    """R18 a buyer's top suppliers by value."""
    g = (c.where(F.col("nombre_entidad") == F.lit(name))
          .groupBy(F.col("proveedor_adjudicado").alias("contratista"))
          .agg(F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor")))
    return (g.orderBy(F.desc("valor"), F.asc_nulls_last("contratista")).limit(n)
             .withColumn("v", bn("valor", 2)))


def entity_alerts(a: DataFrame, name: str) -> DataFrame:
    """R19 alerts of a buyer (by name)."""
    return (a.where(F.col("nombre_entidad") == F.lit(name))
             .select("codigo", "bandera", "detalle", mm("valor_cop", 1).alias("valor_m"), "severidad"))


def supplier_search(c: DataFrame, term: str, n: int = 50) -> DataFrame:
    """R20 suppliers whose name contains the term (upper-cased, literal
    match) or whose id equals it; terms under 3 characters give no rows, in
    the same columns."""
    hit = F.lit(len(term) >= 3) & ( F.upper(F.col("proveedor_adjudicado")).contains(term.upper()) | (F.col("documento_proveedor") == term))
    g = (c.where(hit)
          .groupBy(F.col("proveedor_adjudicado").alias("contratista"), F.col("documento_proveedor").alias("documento"))
          .agg(F.count(F.lit(1)).alias("contratos"), F.countDistinct("nombre_entidad").alias("entidades"),
               F.sum(_v()).alias("valor"), F.min("fecha_de_firma").alias("desde"),
               F.max("fecha_de_firma").alias("hasta")))
    return (g.orderBy(F.desc("valor"), F.asc_nulls_last("documento"), F.asc_nulls_last("contratista")).limit(n)
             .withColumn("valor_m", mm("valor", 1)))


def supplier_history(c: DataFrame, doc: str) -> DataFrame:
    """R21 contract history of a supplier (whole object text)."""
    return (c.where(F.col("documento_proveedor") == F.lit(doc))
             .select(F.col("fecha_de_firma").alias("firma"), F.col("nombre_entidad").alias("entidad"),
                     F.col("tipo_de_contrato").alias("tipo"), F.col("modalidad_de_contratacion").alias("modalidad"),
                     mm(_v(), 1).alias("valor_m"), F.col("objeto_del_contrato").alias("objeto"),
                     F.col("id_contrato")))


def supplier_alerts(a: DataFrame, doc: str) -> DataFrame:
    """R22 alerts of a supplier."""
    return a.where(F.col("documento_proveedor") == F.lit(doc)).select("codigo", "bandera", "detalle")


# ------------------------------------------------------------- catalogue ---

def _c(ctx: Context) -> DataFrame:
    return ctx.contracts(DEFAULT, TEST)


E = O.q(ENTITY)
D = O.q(SUPPLIER_DOC)


@register("r15_entities", with_ctes(f"SELECT DISTINCT nombre_entidad FROM {CC}"))
def r15(ctx):
    """R15 buyer list."""
    return entity_list(_c(ctx))


@register("r16_entity", with_ctes(f"""
SELECT count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS v,
  CAST(sum(CASE WHEN es_sin_competencia THEN valor_del_contrato END) AS DOUBLE) AS vd,
  count(DISTINCT documento_proveedor) AS provs
FROM {CC} WHERE nombre_entidad = {E}"""))
def r16(ctx):
    """R16 buyer summary."""
    return entity_summary(_c(ctx), ENTITY)


@register("r17_entity_modality", with_ctes(f"""
SELECT modalidad_de_contratacion AS m, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor,
  {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 3)} AS v
FROM {CC} WHERE nombre_entidad = {E} GROUP BY 1"""))
def r17(ctx):
    """R17 buyer value by modality."""
    return entity_modalities(_c(ctx), ENTITY)


@register("r18_entity_top", with_ctes(f"""
SELECT proveedor_adjudicado AS contratista, count(*) AS contratos,
  CAST(sum(valor_del_contrato) AS DOUBLE) AS valor, {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e9', 2)} AS v
FROM {CC} WHERE nombre_entidad = {E} GROUP BY 1
ORDER BY sum(valor_del_contrato) DESC, contratista ASC NULLS LAST LIMIT 10"""))
def r18(ctx):
    """R18 buyer's top-10 suppliers."""
    return entity_top_suppliers(_c(ctx), ENTITY, 10)


@register("r19_entity_alerts", f"""WITH {alerts_cte()}
SELECT codigo, bandera, detalle, {O.rnd(O.dbl('valor_cop') + ' / 1e6', 1)} AS valor_m, severidad
FROM alertas WHERE nombre_entidad = {E}""")
def r19(ctx):
    """R19 buyer's alerts."""
    return entity_alerts(alerts_df(ctx), ENTITY)


@register("r20_search", with_ctes(f"""
SELECT proveedor_adjudicado AS contratista, documento_proveedor AS documento, count(*) AS contratos,
  count(DISTINCT nombre_entidad) AS entidades, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor,
  CAST(min(fecha_de_firma) AS VARCHAR) AS desde, CAST(max(fecha_de_firma) AS VARCHAR) AS hasta,
  {O.rnd(O.dbl('sum(valor_del_contrato)') + ' / 1e6', 1)} AS valor_m
FROM {CC}
WHERE contains(upper(proveedor_adjudicado), {O.q(SEARCH.upper())}) OR documento_proveedor = {O.q(SEARCH)}
GROUP BY 1, 2 ORDER BY sum(valor_del_contrato) DESC, documento ASC NULLS LAST, contratista ASC NULLS LAST
LIMIT 50"""))
def r20(ctx):
    """R20 supplier search, top 50 by value."""
    return supplier_search(_c(ctx), SEARCH, 50)


@register("r21_history", with_ctes(f"""
SELECT CAST(fecha_de_firma AS VARCHAR) AS firma, nombre_entidad AS entidad, tipo_de_contrato AS tipo,
  modalidad_de_contratacion AS modalidad, {O.rnd(O.dbl('valor_del_contrato') + ' / 1e6', 1)} AS valor_m,
  objeto_del_contrato AS objeto, id_contrato
FROM {CC} WHERE documento_proveedor = {D}"""))
def r21(ctx):
    """R21 supplier's contract history."""
    return supplier_history(_c(ctx), SUPPLIER_DOC)


@register("r22_supplier_alerts", f"""WITH {alerts_cte()}
SELECT codigo, bandera, detalle FROM alertas WHERE documento_proveedor = {D}""")
def r22(ctx):
    """R22 supplier's alerts."""
    return supplier_alerts(alerts_df(ctx), SUPPLIER_DOC)
