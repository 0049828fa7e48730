"""Alert roll-ups: 0-100 risk scores and the per-flag summary."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veeduria.operators.derive import is_service
from veeduria.params import FLAG_DESCRIPTIONS, FLAG_NAMES, SCORE_CAP, Params
from veeduria.session import reuse


def _score(a: DataFrame, key: str, label: str) -> DataFrame:
    """Capped sum of severities per key. Alerts are first added up per (key,
    label, flag), a hash aggregate of numbers; the ``max`` of a string and the
    set of flags, which need sorted or object aggregates, run over these rows,
    as many per key as it has labels and flags."""
    g = (a.where(F.col(key).isNotNull())
          .groupBy(key, label, "codigo")
          .agg(F.sum("severidad").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum("valor_cop").alias("_v"))
          .groupBy(key)
          .agg(F.max(label).alias("label"), F.sum("_s").alias("raw_score"), F.sum("_n").alias("n_alertas"),
               F.sum("_v").alias("valor_bajo_alerta"), F.sort_array(F.collect_set("codigo")).alias("banderas")))
    g = with_percent_rank(reuse(g), "raw_score")     # one row per key; the ranks read it again, not the alerts
    return g.select(F.col(key).alias("key"), "label",
                    F.least(F.lit(SCORE_CAP).cast("bigint"), F.col("raw_score")).cast("int").alias("score"),
                    "raw_score", "pct_rank", "n_alertas", "valor_bajo_alerta", "banderas")


RANK_BLOCK = 256


def with_percent_rank(g: DataFrame, col: str) -> DataFrame:
    """``percent_rank()`` over the whole-number column ``col``: (rank - 1) /
    (n - 1), 0 for n = 1. Rows are counted per value, values are added up
    within blocks of ``RANK_BLOCK`` neighbouring ones and over the blocks'
    totals, so no window holds more than a block or the totals."""
    dist = g.groupBy(col).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.floor(F.col(col) / RANK_BLOCK))
    up_to = Window.unboundedPreceding, -1
    totals = dist.groupBy("_b").agg(F.sum("_c").alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(*up_to)), F.lit(0)).alias("_base"),
                           F.sum("_t").over(Window.partitionBy()).alias("_n"))
    inside = F.sum("_c").over(Window.partitionBy("_b").orderBy(col).rowsBetween(*up_to))
    dist = dist.withColumn("_in", F.coalesce(inside, F.lit(0))).join(totals, "_b")
    pr = F.when(F.col("_n") > 1, (F.col("_base") + F.col("_in")).cast("double") / (F.col("_n") - 1).cast("double")) \
          .otherwise(F.lit(0.0))
    return g.join(dist.select(col, pr.alias("pct_rank")), col)


def entity_scores(a: DataFrame) -> DataFrame:
    """R2: buyer score (alerts that carry a buyer id)."""
    return _score(a, "nit_entidad", "nombre_entidad")


def supplier_scores(a: DataFrame) -> DataFrame:
    """Supplier score (alerts that carry a supplier id)."""
    return _score(a, "documento_proveedor", "proveedor")


# Alert key shapes for contract coverage: flags, key columns, row predicate.
def _shapes(p: Params):
    nc = F.col("es_sin_competencia")
    ops = F.col("es_persona_natural") & is_service(p)
    return [
        (1, ["F01"], ["nit_entidad", "documento_proveedor", "anio"], nc),
        (2, ["F02"], ["documento_proveedor", "anio"], None),
        (3, ["F06"], ["documento_proveedor", "anio"], ops),
        (4, ["F04", "F08"], ["nit_entidad", "anio"], None),
    ]


CODES = sorted(FLAG_NAMES)


def _weights(a: DataFrame, codes: list[str], cols: list[str]) -> DataFrame:
    """Per alert key: summed severity, number of alerts, and the flags as
    bits, so that the aggregates hold numbers only (hash aggregates)."""
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(CODES) for x in (k, 1 << i)]), F.col("codigo"))
    return (a.where(F.col("codigo").isin(codes) & functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in cols]))
             .groupBy(*cols).agg(F.sum("severidad").alias("raw"), F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits")))


def contract_weights(c: DataFrame, a: DataFrame, p: Params = Params()) -> DataFrame:
    """(id_contrato, raw, n, bits) parts to be added up per contract id:
    group alerts by the group's keys and the flag's own row predicate,
    contract-level alerts by id.

    Alerts are first summed per key, so a contract row meets at most one row
    per shape: one left join on typed columns for each shape, one scan of the
    contracts and one row out. No side carries a hint, since the alerts grow
    with the data: AQE broadcasts a small side, where the joins run within
    the scan's tasks, and splits skewed keys otherwise."""
    shapes = _shapes(p)
    used = sorted({k for _, _, cols, _ in shapes for k in cols})
    rows = c.select("id_contrato", *used, *[(F.lit(True) if pred is None else pred).alias(f"_ok{k}")
                                            for k, _, _, pred in shapes])
    for k, codes, cols, _ in shapes:
        w = _weights(a, codes, cols).select(*[F.col(x).alias(f"_{x}") for x in cols],
                                            *[F.col(x).alias(f"{x}{k}") for x in ("raw", "n", "bits")])
        on = functools.reduce(Column.__and__, [F.col(x) == F.col(f"_{x}") for x in cols])
        rows = rows.join(w, on & F.col(f"_ok{k}"), "left").drop(*[f"_{x}" for x in cols])

    def over_shapes(name: str, add) -> Column:
        return functools.reduce(add, [F.coalesce(F.col(f"{name}{k}"), F.lit(0)) for k, *_ in shapes])
    grouped = rows.select("id_contrato", over_shapes("raw", Column.__add__).alias("raw"),
                          over_shapes("n", Column.__add__).alias("n"),
                          over_shapes("bits", Column.bitwiseOR).alias("bits")).where("n > 0")
    return grouped.unionByName(_weights(a, ["F09", "F10"], ["id_contrato"]))


def contract_scores(c: DataFrame, a: DataFrame, p: Params = Params()) -> DataFrame:
    """Contract score = capped sum of the severities covering it."""
    g = contract_weights(c, a, p).groupBy("id_contrato").agg(
        F.sum("raw").alias("raw_score"), F.sum("n").alias("n_alertas"), F.bit_or("bits").alias("bits"))
    flags = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(CODES)]),
                     lambda x: x.isNotNull())
    return g.select(F.col("id_contrato").alias("key"),
                    F.least(F.lit(SCORE_CAP).cast("bigint"), F.col("raw_score")).cast("int").alias("score"),
                    "raw_score", "n_alertas", flags.alias("banderas"))


def flag_descriptions(spark: SparkSession) -> DataFrame:
    """R6 dimension: fixed 8-row table of flag descriptions."""
    return spark.createDataFrame(sorted(FLAG_DESCRIPTIONS.items()), "codigo string, descripcion string")


def flag_summary(a: DataFrame) -> DataFrame:
    """R4 + R6: alerts and value (billions, 1 decimal) per flag, with the
    flag description (broadcast: the dimension has a fixed 8 rows)."""
    g = (a.groupBy("codigo", "bandera").agg(F.count(F.lit(1)).alias("n"), F.sum("valor_cop").alias("valor"))
          .groupBy("codigo").agg(F.max("bandera").alias("bandera"), F.sum("n").alias("n"), F.sum("valor").alias("valor")))
    g = g.withColumn("v", F.round(F.col("valor").cast("double") / F.lit(1e9) * F.lit(10.0), 0) / F.lit(10.0))
    return g.join(F.broadcast(flag_descriptions(a.sparkSession)), "codigo", "left")


def alert_total(a: DataFrame) -> DataFrame:
    """Number of alerts."""
    return a.agg(F.count(F.lit(1)).alias("n"))
