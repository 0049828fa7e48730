"""Incremental refresh with Structured Streaming.

Landed files are consumed as a file-source stream (``availableNow`` trigger:
process what has landed, then stop; the checkpoint remembers which files
were done, so the next run only reads new ones and a lost executor only
replays its micro-batch).

A watermark drops what comes behind it. Here nothing is dropped: each
micro-batch is split by the watermark that the batches before it have
reached (their greatest event time, kept per batch in the table ``bounds``,
less the delay). Counts and exact sums can be added up, so a batch leaves its
partial sums per week and key, and readers add them by key; the sums of late
rows are kept apart (``tarde``) and the late rows themselves go to a side
table with a count. There is no operator state to grow or to lose: a batch's
folders are named by its id and are written again, the same, if it is
replayed.

Weeks are counted from dates alone (Monday is weekday 0), so the session's
time zone plays no part for TIMESTAMP_NTZ event times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, pattern: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over a landed folder (optionally only the files
    matching ``pattern``); the schema is taken from the Parquet footers
    once, never inferred per batch."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{pattern}" if pattern else folder).schema
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def week_of(ts: str) -> Column:
    """The Monday on or before the day of an event."""
    day = F.to_date(F.col(ts))
    return F.date_sub(day, F.weekday(day))


def weekly_counts(ev: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Monday-based weeks per key: count and exact value sum; mergeable, so
    weeks of several batches are added up."""
    return (ev.groupBy(week_of(ts).alias("semana"), *keys)
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("v")))


def _reached(spark: SparkSession, table_dir: str, batch_id: int, delay: str):
    """The watermark before a batch: greatest event time of the batches
    before it, less the delay; null for the first one."""
    b = spark.read.schema("hasta timestamp_ntz, batch_id int").parquet(f"{table_dir}/bounds")
    return (b.where(F.col("batch_id") < batch_id)
             .agg((F.max("hasta") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"])


def weekly_writer(table_dir: str, keys: list[str], value: str, delay: str, ts: str = "ts"):
    """foreachBatch writer: partial sums, late rows and the time bound of a
    batch, each in a folder of the batch's id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _reached(spark, table_dir, batch_id, delay)
        # late as the engine's watermark has it: the week ended at or before it
        end = F.date_add(week_of(ts), 7).cast("timestamp_ntz")
        late = F.lit(False) if mark is None else F.coalesce(end <= F.lit(mark).cast("timestamp_ntz"), F.lit(False))
        rows = batch.withColumn("tarde", late)
        (weekly_counts(rows, ["tarde", *keys], value, ts).write.mode("overwrite")
            .parquet(f"{table_dir}/partials/batch_id={batch_id}"))
        (rows.where("tarde").drop("tarde").write.mode("overwrite").parquet(f"{table_dir}/late/batch_id={batch_id}"))
        # last, as the next batch's watermark depends on it
        (batch.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("hasta")).write.mode("overwrite")
            .parquet(f"{table_dir}/bounds/batch_id={batch_id}"))
    return write


def weekly_table(spark: SparkSession, table_dir: str, keys: list[str]) -> DataFrame:
    """The weekly table of all batches, late rows merged by key: semana,
    keys, n, v, and n_tarde, how many of the n came late."""
    p = spark.read.parquet(f"{table_dir}/partials")
    return (p.groupBy("semana", *keys)
             .agg(F.sum("n").alias("n"), F.sum("v").cast("decimal(28,2)").alias("v"),
                  F.sum(F.when(F.col("tarde"), F.col("n")).otherwise(0)).alias("n_tarde")))


def late_rows(spark: SparkSession, table_dir: str) -> DataFrame:
    """The late rows as they came, with their batch."""
    return spark.read.parquet(f"{table_dir}/late")


def late_count(spark: SparkSession, table_dir: str) -> int:
    return spark.read.parquet(f"{table_dir}/partials").agg(
        F.coalesce(F.sum(F.when(F.col("tarde"), F.col("n"))), F.lit(0))).first()[0]


def run_weekly(spark: SparkSession, folder: str, pattern: str | None, table_dir: str, checkpoint: str,
               keys: list[str] = ("event_type",), value: str = "value", delay: str = "7 days",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the weekly stream to completion of the landed data and return the
    current weekly table."""
    keys, table_dir = list(keys), table_dir.rstrip("/")
    # so that readers find the folder before the first batch
    (spark.createDataFrame([], "hasta timestamp_ntz").write.mode("ignore").parquet(f"{table_dir}/bounds/batch_id=-1"))
    q = (event_stream(spark, folder, pattern, max_files_per_trigger).writeStream
            .foreachBatch(weekly_writer(table_dir, keys, value, delay))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return weekly_table(spark, table_dir, keys)


def dedupe_writer(sink_dir: str, key: str, ts: str, delay_days: int):
    """foreachBatch writer: of a batch, one row per id that no earlier batch
    has kept within ``delay_days`` of its day; earlier rows are looked up in
    the touched days only (the sink is partitioned by day)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("dia", F.to_date(F.col(ts)))
        # days are few, whatever the number of rows
        days = [r.dia for r in rows.select(F.explode(F.sequence(
            F.date_sub("dia", delay_days), F.date_add("dia", delay_days))).alias("dia")).distinct().collect()]
        schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.IntegerType())])
        seen = (spark.read.schema(schema).parquet(sink_dir)
                     .where((F.col("batch_id") < batch_id) & F.col("dia").isin(days))
                     .select(F.col(key).alias("_k"), F.col("dia").alias("_d")).distinct())
        first = Window.partitionBy(key).orderBy(F.asc_nulls_last(ts), F.xxhash64(*batch.columns))
        near = (F.col(key) == F.col("_k")) & (F.abs(F.datediff("dia", "_d")) <= delay_days)
        named = rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
        (named.join(seen, near, "left_anti").unionByName(rows.where(F.col(key).isNull()))
              .write.mode("overwrite").partitionBy("dia").parquet(f"{sink_dir}/batch_id={batch_id}"))
    return write


def run_dedupe(spark: SparkSession, folder: str, pattern: str | None, sink_dir: str, checkpoint: str,
               key: str = "event_id", ts: str = "ts", delay_days: int = 1) -> DataFrame:
    """Drop replayed records (same id, event times within ``delay_days``),
    however late they come; rows without an id are all kept."""
    ev = event_stream(spark, folder, pattern)
    sink_dir = sink_dir.rstrip("/")
    # so that readers find the folder before the first batch
    spark.createDataFrame([], ev.schema).write.mode("ignore").parquet(f"{sink_dir}/batch_id=-1/dia=0001-01-01")
    q = (ev.writeStream.foreachBatch(dedupe_writer(sink_dir, key, ts, delay_days))
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*ev.schema.fields, T.StructField("dia", T.DateType()), T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(sink_dir).select(*ev.columns)
