"""Period studies (R29-R38): the queries behind the published reports,
re-stated as DataFrame plans over the clean contract table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.operators.derive import is_service, is_vague
from veeduria.operators.flags import entity_labels, entity_months, with_month_stats
from veeduria.operators.ranks import exact_median
from veeduria.params import Params
from veeduria.plans import oracle as O
from veeduria.plans.catalog import (CUSTOMER_SUPPLIER, DEFAULT, NATION_CUSTOMER, TEST, register, with_ctes)
from veeduria.plans.context import Context
from veeduria.plans.profiles import ENTITY


def _v():
    """The contract value column."""
    return F.col("valor_del_contrato")


# ------------------------------------------------------------ operators ---

def same_month(c: DataFrame, month: int) -> DataFrame:
    """R29 one calendar month across years, with the ratio to the previous
    year's same month (only when that year exists)."""
    g = (c.where(F.col("mes") == month).groupBy("anio")
          .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("valor")))
    prev = g.select((F.col("anio") + 1).alias("anio"), F.col("n").alias("n_prev"),
                    F.col("valor").alias("valor_prev"))
    return (g.join(prev, "anio", "left")
             .select("anio", "n", "valor", (F.col("n") / F.col("n_prev")).alias("ratio_n"),
                     (F.col("valor").cast("double") / F.col("valor_prev").cast("double")).alias("ratio_valor")))


def month_of(c: DataFrame, month: str) -> DataFrame:
    """Rows of one 'yyyy-MM' month (year filter prunes partitions)."""
    y, m = int(month[:4]), int(month[5:7])
    return c.where((F.col("anio") == y) & (F.col("mes") == m))


def top_days(c: DataFrame, month: str, n: int = 10) -> DataFrame:
    """R30 busiest days of a month."""
    g = (month_of(c, month).groupBy(F.to_date("fecha_de_firma").alias("dia"))
         .agg(F.count(F.lit(1)).alias("contratos"), F.sum(_v()).alias("valor")))
    return g.orderBy(F.desc("contratos"), F.asc("dia")).limit(n)


def composition(c: DataFrame, month: str, p: Params = Params()) -> DataFrame:
    """R31 composition of a period: shares of services, natural persons,
    direct awards and vague objects; mean and exact median value of service
    contracts with natural persons."""
    m = month_of(c, month)
    ops = is_service(p) & F.col("es_persona_natural")
    g = m.agg(F.count(F.lit(1)).alias("n"),
              F.count(F.when(is_service(p), 1)).alias("n_servicios"),
              F.count(F.when(F.col("es_persona_natural"), 1)).alias("n_natural"),
              F.sum(F.when(F.col("es_persona_natural"), _v())).alias("v_natural"),
              F.count(F.when(F.col("es_sin_competencia"), 1)).alias("n_sin_competencia"),
              F.count(F.when(is_vague(p), 1)).alias("n_vaga"),
              F.sum(F.when(is_vague(p), _v())).alias("v_vaga"),
              F.countDistinct("documento_proveedor").alias("proveedores"),
              F.count(F.when(ops, 1)).alias("n_ops"), F.sum(F.when(ops, _v())).alias("v_ops"))
    g = g.select("*", (F.lit(100.0) * F.col("n_servicios") / F.col("n")).alias("pct_servicios"),
                 (F.lit(100.0) * F.col("n_natural") / F.col("n")).alias("pct_natural"),
                 (F.lit(100.0) * F.col("n_sin_competencia") / F.col("n")).alias("pct_sin_competencia"),
                 (F.col("v_ops").cast("double") / F.col("n_ops").cast("double")).alias("media_ops"))
    med = exact_median(m.where(ops), "valor_del_contrato", alias="mediana_ops")
    # one-row result: attached as a scalar subquery, not a join
    return g.withColumn("mediana_ops", med.scalar())


def first_time_suppliers(c: DataFrame, month: str) -> DataFrame:
    """R32 suppliers of a month with no contract before it: one aggregate
    per supplier (first date, contracts in the month), no join."""
    y, m = int(month[:4]), int(month[5:7])
    start = F.make_date(F.lit(y), F.lit(m), F.lit(1))
    inm = (F.col("anio") == y) & (F.col("mes") == m)
    g = (c.where(F.col("documento_proveedor").isNotNull())
          .groupBy("documento_proveedor")
          .agg(F.min("fecha_de_firma").alias("primera"), F.count(F.when(inm, 1)).alias("n_mes"),
               F.sum(F.when(inm, _v())).alias("valor_mes")))
    return g.where((F.col("n_mes") > 0) & (F.to_date("primera") >= start))


def multiple_of_mean(c: DataFrame, month: str, min_n: int, factor: float) -> DataFrame:
    """R33 buyers whose contracts in a month reach ``min_n`` and exceed
    ``factor`` times their own mean monthly count (months with contracts)."""
    y, m = int(month[:4]), int(month[5:7])
    s = with_month_stats(entity_months(c))
    mean = F.col("s1").cast("double") / F.col("meses").cast("double")
    s = s.where((F.year("mes_firma") == y) & (F.month("mes_firma") == m))
    hit = (s.withColumn("media", mean).withColumn("veces", F.col("n").cast("double") / F.col("media"))
            .where((F.col("n") >= min_n) & (F.col("n").cast("double") > F.lit(float(factor)) * F.col("media"))))
    return (hit.join(entity_labels(c), "nit_entidad")
               .select("nit_entidad", F.col("ne").alias("nombre_entidad"), "n", "total", "media", "veces"))


def pair_history(c: DataFrame, entity_name: str) -> DataFrame:
    """R34 buyer -> supplier history by year, with the largest single-day
    burst of the pair in that year."""
    e = c.where(F.col("nombre_entidad") == F.lit(entity_name))
    daily = (e.groupBy("nit_entidad", "documento_proveedor", "anio", F.to_date("fecha_de_firma").alias("dia"))
              .agg(F.count(F.lit(1)).alias("nd"), F.sum(_v()).alias("vd")))
    return (daily.groupBy("nit_entidad", "documento_proveedor", "anio")
                 .agg(F.sum("nd").alias("n"), F.sum("vd").alias("valor"), F.max("nd").alias("max_dia")))


def flows(as_supplier: DataFrame, as_buyer: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R35/R38 money received as supplier vs contracted out as buyer, per
    normalised id (and optional project key): full outer join of two
    aggregates; margin = received - contracted."""
    by = list(by or [])
    rec = (as_supplier.where(F.col("documento_proveedor").isNotNull())
           .groupBy(F.col("documento_proveedor").alias("id"), *by).agg(F.sum(_v()).alias("recibido")))
    out = (as_buyer.where(F.col("nit_entidad").isNotNull())
           .groupBy(F.col("nit_entidad").alias("id"), *by).agg(F.sum(_v()).alias("contratado")))
    j = rec.join(out, ["id", *by], "full_outer")
    z = F.lit(0).cast("decimal(28,4)")
    return j.withColumn("margen", F.coalesce("recibido", z) - F.coalesce("contratado", z))


def pre_post(c: DataFrame, cut: str) -> DataFrame:
    """R36 modality shares before and after a cut date."""
    periodo = F.when(F.col("fecha_de_firma") < F.lit(cut).cast("timestamp_ntz"), F.lit("antes")).otherwise(F.lit("despues"))
    g = (c.groupBy(periodo.alias("periodo"), F.col("modalidad_de_contratacion").alias("modalidad"))
          .agg(F.count(F.lit(1)).alias("n"), F.sum(_v()).alias("valor")))
    w = Window.partitionBy("periodo")
    # exact decimal total per period, then one double division
    return g.withColumn("share", F.col("valor").cast("double") / F.sum("valor").over(w).cast("double"))


def largest_contract(c: DataFrame) -> DataFrame:
    """R37 each buyer's largest contract with its dates, modality,
    justification and paid value. Step 1 is a hash aggregate of the maximum
    value per buyer; an equi-join on (buyer, value) keeps only the tied
    candidates; ``max(struct)`` then breaks ties over those few rows, so the
    string-bearing (sort-based) aggregate never sees the whole table."""
    b = c.where(F.col("nit_entidad").isNotNull())
    top = b.groupBy("nit_entidad").agg(F.max(_v()).alias("valor_del_contrato"))
    cand = b.join(top, ["nit_entidad", "valor_del_contrato"])
    s = F.struct(_v().alias("valor"), F.col("id_contrato"), F.col("fecha_de_firma"),
                 F.col("fecha_de_inicio_del_contrato"), F.col("fecha_de_fin_del_contrato"),
                 F.col("modalidad_de_contratacion"), F.col("justificacion_modalidad_de"), F.col("valor_pagado"))
    g = cand.groupBy("nit_entidad").agg(F.max(s).alias("m"))
    return g.select("nit_entidad", "m.*")


# ------------------------------------------------------------- catalogue ---

CC = O.cte_name(DEFAULT)
MONTH = "1998-01"


def _c(ctx: Context) -> DataFrame:
    return ctx.contracts(DEFAULT, TEST)


@register("r29_same_month", with_ctes(f"""
WITH_G
SELECT g.anio, g.n, CAST(g.valor AS DOUBLE) AS valor, g.n / p.n AS ratio_n,
       CAST(g.valor AS DOUBLE) / CAST(p.valor AS DOUBLE) AS ratio_valor
FROM g LEFT JOIN g p ON g.anio = p.anio + 1""".replace("WITH_G\n", ""), [DEFAULT],
    f"g AS (SELECT anio, count(*) AS n, sum(valor_del_contrato) AS valor FROM {CC} WHERE mes = 1 GROUP BY anio)"))
def r29(ctx):
    """R29 January of each year and the ratio to the previous January."""
    return same_month(_c(ctx), 1)


@register("r30_top_days", with_ctes(f"""
SELECT CAST(CAST(fecha_de_firma AS DATE) AS VARCHAR) AS dia, count(*) AS contratos,
       CAST(sum(valor_del_contrato) AS DOUBLE) AS valor
FROM {CC} WHERE anio = 1998 AND mes = 1 GROUP BY 1 ORDER BY contratos DESC, dia ASC LIMIT 10"""))
def r30(ctx):
    """R30 ten busiest days of a month."""
    return top_days(_c(ctx), MONTH, 10)


_svc = O.ilike_any("tipo_de_contrato", TEST.service)
_vag = O.ilike_any("objeto_del_contrato", TEST.vague)
_ops = f"({_svc} AND es_persona_natural)"


@register("r31_composition", with_ctes(f"""
SELECT count(*) AS n, CAST(count_if({_svc}) AS BIGINT) AS n_servicios, CAST(count_if(es_persona_natural) AS BIGINT) AS n_natural,
  CAST(sum(CASE WHEN es_persona_natural THEN valor_del_contrato END) AS DOUBLE) AS v_natural,
  CAST(count_if(es_sin_competencia) AS BIGINT) AS n_sin_competencia, CAST(count_if({_vag}) AS BIGINT) AS n_vaga,
  CAST(sum(CASE WHEN {_vag} THEN valor_del_contrato END) AS DOUBLE) AS v_vaga,
  count(DISTINCT documento_proveedor) AS proveedores, CAST(count_if({_ops}) AS BIGINT) AS n_ops,
  CAST(sum(CASE WHEN {_ops} THEN valor_del_contrato END) AS DOUBLE) AS v_ops,
  100.0 * count_if({_svc}) / count(*) AS pct_servicios, 100.0 * count_if(es_persona_natural) / count(*) AS pct_natural,
  100.0 * count_if(es_sin_competencia) / count(*) AS pct_sin_competencia,
  CAST(sum(CASE WHEN {_ops} THEN valor_del_contrato END) AS DOUBLE) / CAST(count_if({_ops}) AS DOUBLE) AS media_ops,
  quantile_cont(CASE WHEN {_ops} THEN CAST(valor_del_contrato AS DOUBLE) END, 0.5) AS mediana_ops
FROM {CC} WHERE anio = 1998 AND mes = 1"""))
def r31(ctx):
    """R31 composition of a month with mean and exact median."""
    return composition(_c(ctx), MONTH, TEST)


FT_MONTH = "1995-06"


@register("r32_first_time", with_ctes(f"""
SELECT documento_proveedor, CAST(min(fecha_de_firma) AS VARCHAR) AS primera,
  CAST(count_if(anio = 1995 AND mes = 6) AS BIGINT) AS n_mes,
  CAST(sum(CASE WHEN anio = 1995 AND mes = 6 THEN valor_del_contrato END) AS DOUBLE) AS valor_mes
FROM {O.cte_name(NATION_CUSTOMER)} WHERE documento_proveedor IS NOT NULL GROUP BY documento_proveedor
HAVING count_if(anio = 1995 AND mes = 6) > 0 AND CAST(min(fecha_de_firma) AS DATE) >= DATE '1995-06-01'""",
    [NATION_CUSTOMER]))
def r32(ctx):
    """R32 first-time suppliers of a month (customers as suppliers)."""
    return first_time_suppliers(ctx.contracts(NATION_CUSTOMER, TEST), FT_MONTH)


@register("r33_multiple", with_ctes(f"""
SELECT nit_entidad, nombre_entidad, n, CAST(total AS DOUBLE) AS total, media, n / media AS veces FROM (
  SELECT *, CAST(s1 AS DOUBLE) / CAST(meses AS DOUBLE) AS media FROM (
    SELECT *, count(*) OVER w AS meses, sum(n) OVER w AS s1 FROM (
      SELECT nit_entidad, mes_firma, count(*) AS n, sum(valor_del_contrato) AS total,
             (SELECT max(x.nombre_entidad) FROM {CC} x WHERE x.nit_entidad = t.nit_entidad) AS nombre_entidad
      FROM {CC} t WHERE nit_entidad IS NOT NULL GROUP BY t.nit_entidad, t.mes_firma)
    WINDOW w AS (PARTITION BY nit_entidad)))
WHERE year(mes_firma) = 1998 AND month(mes_firma) = 1 AND n >= 30 AND CAST(n AS DOUBLE) > 1.0 * media"""))
def r33(ctx):
    """R33 buyers above their own mean monthly count in a month."""
    return multiple_of_mean(_c(ctx), MONTH, 30, 1.0)


@register("r34_pair", with_ctes(f"""
SELECT nit_entidad, documento_proveedor, anio, CAST(sum(nd) AS BIGINT) AS n, CAST(sum(vd) AS DOUBLE) AS valor, max(nd) AS max_dia
FROM (SELECT nit_entidad, documento_proveedor, anio, CAST(fecha_de_firma AS DATE) AS dia, count(*) AS nd,
             sum(valor_del_contrato) AS vd
      FROM {CC} WHERE nombre_entidad = {O.q(ENTITY)} GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3"""))
def r34(ctx):
    """R34 buyer -> supplier history by year with single-day bursts."""
    return pair_history(_c(ctx), ENTITY)


def _flow_sql(by: str = "") -> str:
    k = f", {by}" if by else ""
    return with_ctes(f"""
SELECT coalesce(r.id, o.id) AS id{', coalesce(r.' + by + ', o.' + by + ') AS ' + by if by else ''},
       CAST(r.recibido AS DOUBLE) AS recibido, CAST(o.contratado AS DOUBLE) AS contratado,
       CAST(coalesce(r.recibido, 0) - coalesce(o.contratado, 0) AS DOUBLE) AS margen
FROM (SELECT documento_proveedor AS id{k}, sum(valor_del_contrato) AS recibido FROM {O.cte_name(NATION_CUSTOMER)}
      WHERE documento_proveedor IS NOT NULL GROUP BY ALL) r
FULL OUTER JOIN (SELECT nit_entidad AS id{k}, sum(valor_del_contrato) AS contratado FROM {O.cte_name(CUSTOMER_SUPPLIER)}
      WHERE nit_entidad IS NOT NULL {'AND es_sin_competencia' if by else ''} GROUP BY ALL) o
  ON r.id = o.id{' AND r.' + by + ' = o.' + by if by else ''}""", [NATION_CUSTOMER, CUSTOMER_SUPPLIER])


@register("r35_flow", _flow_sql())
def r35(ctx):
    """R35 received as supplier vs contracted out as buyer, per id."""
    return flows(ctx.contracts(NATION_CUSTOMER, TEST), ctx.contracts(CUSTOMER_SUPPLIER, TEST))


@register("r38_margin", _flow_sql("anio"))
def r38(ctx):
    """R38 retained margin per id and project key (year), out-flow limited
    to non-competitive awards."""
    out = ctx.contracts(CUSTOMER_SUPPLIER, TEST).where(F.col("es_sin_competencia"))
    return flows(ctx.contracts(NATION_CUSTOMER, TEST), out, ["anio"])


@register("r36_pre_post", with_ctes(f"""
SELECT periodo, modalidad, n, CAST(valor AS DOUBLE) AS valor,
       CAST(valor AS DOUBLE) / CAST(sum(valor) OVER (PARTITION BY periodo) AS DOUBLE) AS share
FROM (SELECT CASE WHEN fecha_de_firma < TIMESTAMP '1998-01-01' THEN 'antes' ELSE 'despues' END AS periodo,
             modalidad_de_contratacion AS modalidad, count(*) AS n, sum(valor_del_contrato) AS valor
      FROM {CC} GROUP BY 1, 2)"""))
def r36(ctx):
    """R36 modality shares before and after a cut date."""
    return pre_post(_c(ctx), "1998-01-01")


@register("r37_largest", with_ctes(f"""
SELECT nit_entidad, CAST(valor_del_contrato AS DOUBLE) AS valor, id_contrato,
  CAST(fecha_de_firma AS VARCHAR) AS fecha_de_firma, CAST(fecha_de_inicio_del_contrato AS VARCHAR) AS fecha_de_inicio_del_contrato,
  CAST(fecha_de_fin_del_contrato AS VARCHAR) AS fecha_de_fin_del_contrato, modalidad_de_contratacion,
  justificacion_modalidad_de, CAST(valor_pagado AS DOUBLE) AS valor_pagado
FROM (SELECT *, row_number() OVER (PARTITION BY nit_entidad ORDER BY valor_del_contrato DESC, id_contrato DESC,
        fecha_de_firma DESC, fecha_de_inicio_del_contrato DESC, fecha_de_fin_del_contrato DESC,
        modalidad_de_contratacion DESC NULLS LAST, justificacion_modalidad_de DESC NULLS LAST,
        valor_pagado DESC NULLS LAST) AS rn
      FROM {CC} WHERE nit_entidad IS NOT NULL) WHERE rn = 1"""))
def r37(ctx):
    """R37 each buyer's largest contract."""
    return largest_contract(_c(ctx))
