"""Landed contract records: scans, windows, ranges, samples.

The portal download itself (HTTP paging with retries) is a single-machine
client and is not part of the engine; pages are expected to be landed as
JSON (one record per line, or one JSON array per file) or Parquet, and are
scanned here in parallel with an explicit schema (no inference pass).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.schema import CONTRACT_COLUMNS, LANDED_CONTRACT


CORRUPT = "_corrupt_record"


LANDED_SCHEMA = T.StructType([*LANDED_CONTRACT.fields, T.StructField(CORRUPT, T.StringType())])


def _landed(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return (spark.read.schema(LANDED_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def is_parsed() -> Column:
    """Whether a landed record could be parsed. A record's id takes part (by
    none of its characters): a query that needs the corrupt column alone, such
    as a count, is refused by the scan, which would have nothing to parse."""
    return F.concat_ws("", F.col(CORRUPT), F.substring("id_contrato", 1, 0)) == ""


def read_landed_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S1 + S2 + N1: scan landed JSON with the fixed text schema; fields
    absent from the records come back as NULL, extra fields are dropped.
    ``multi_line=True`` for files holding one JSON array (an API page).
    Records that can't be parsed are left out here and kept by
    ``corrupt_records``, so none is lost without trace."""
    return _landed(spark, path, multi_line).where(is_parsed()).select(*CONTRACT_COLUMNS)


def corrupt_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, n, example, last_id): unparsable records per landed file, and
    the greatest contract id that could be read from them."""
    bad = _landed(spark, path, multi_line).select(CORRUPT, "id_contrato", F.input_file_name().alias("file"))
    return (bad.where(~is_parsed()).groupBy("file")
               .agg(F.count(F.lit(1)).alias("n"), F.min(CORRUPT).alias("example"),
                    F.max("id_contrato").alias("last_id")))


def read_landed_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S1 for Parquet landings (column pruning and pushdown at the scan)."""
    df = spark.read.parquet(path)
    missing = [c for c in CONTRACT_COLUMNS if c not in df.columns]
    for c in missing:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*CONTRACT_COLUMNS)


def source_filter(df: DataFrame) -> DataFrame:
    """S3: signature date present and positive value (typed columns)."""
    return df.where(F.col("fecha_de_firma").isNotNull() & (F.col("valor_del_contrato") > 0))


def month_windows(df: DataFrame, desde: str | dt.date | None = None, hasta: str | dt.date | None = None,
                  col: str = "fecha_de_firma") -> DataFrame:
    """Half-open month windows [start, end) from ``desde`` (first window
    may start mid-month) to the month of ``hasta``; bounds default to the
    data's min and max date. One global min/max aggregate, then a generated
    sequence: the window table has one row per month."""
    lo = F.lit(str(desde)).cast("date") if desde else F.to_date(F.min(col))
    hi = F.lit(str(hasta)).cast("date") if hasta else F.to_date(F.max(col))
    b = df.agg(lo.alias("lo"), hi.alias("hi"))
    m = b.select("lo", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"),
                                            F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return m.select(F.greatest(F.col("m"), F.col("lo")).alias("start"),
                    F.add_months(F.col("m"), 1).alias("end"))


def date_range(df: DataFrame, start: str, end: str, col: str = "fecha_de_firma") -> DataFrame:
    """Rows with start <= date < end (pushed to the scan; with a table
    partitioned by year only the touched years are read)."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    out = df.where((F.col(col) >= s) & (F.col(col) < e))
    if "anio" in df.columns:
        out = out.where(F.col("anio").between(int(start[:4]), int(end[:4])))
    return out


def latest(df: DataFrame, n: int, col: str = "fecha_de_firma") -> DataFrame:
    """The N most recent records (TakeOrderedAndProject: per-task top-N)."""
    return df.orderBy(F.desc_nulls_last(col), F.asc("id_contrato"), F.desc("valor_del_contrato"),
                      F.asc_nulls_last("documento_proveedor")).limit(n)


def load_count(df: DataFrame) -> DataFrame:
    """Rows loaded."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """Parameterised SQL with ``:name`` markers bound as literals
    (no string splicing of user input)."""
    return spark.sql(text, args=params or None)
