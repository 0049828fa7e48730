"""Sinks: Parquet tables, CSV and JSON exports."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = "anio",
                dynamic: bool = False) -> None:
    """Full rebuild (``overwrite``), append of a batch, or, with
    ``dynamic=True``, replacement of only the partitions present in ``df``
    (dated reloads rewrite the touched years, nothing else)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV export with header (one file per task; no single-task merge).
    Quotes are doubled; ``read_csv`` reads line breaks within a field back, and
    ``compression`` (such as gzip) by the files' names. A file whose fields may
    hold line breaks is read by one task with or without it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Reads what ``write_csv`` wrote, line breaks and quotes included."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
                 .option("multiLine", True).csv(path))


def write_sorted(df: DataFrame, path: str, order: list[Column], write=write_csv) -> None:
    """Export in a total order: ranges of the order are sorted side by
    side, and the files, by name, follow one another. ``order`` should end in
    a key, so that ties are settled."""
    write(df.orderBy(*order), path)


def with_place(rows: DataFrame, name: str = "orden") -> DataFrame:
    """Rows read from files, with their place (from 1) in the files' order:
    files by name, rows as they stand. Rows are counted per file split; only
    these counts are added up in one place."""
    at = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                     F.monotonically_increasing_id().alias("_id"))
    splits = at.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    up_to = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))
    return (at.join(base, ["_file", "_split"])
              .withColumn(name, F.col("_base") + F.col("_id") - F.col("_first") + 1)
              .drop("_file", "_split", "_id", "_first", "_base"))


def write_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """JSON lines export (nested columns kept), one gzip file per
    task (and folder, with ``partition_by``): the text repeats every field's
    name in every row, so a low level is enough."""
    (df.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "THREE")
       .partitionBy(*partition_by).json(path))


BUNDLE_ROWS = 10_000


def json_bundle(sections: dict[str, tuple[DataFrame, list[Column]]], max_rows: int = BUNDLE_ROWS) -> DataFrame:
    """One JSON document of several small result sets, each a frame and
    its order; sections stand in the given order, rows in their frame's. A
    section is a list inside one row, so its size is checked: more than
    ``max_rows`` rows end the job with an error, and are not gathered."""
    parts = []
    for k, (name, (frame, order)) in enumerate(sections.items()):
        # one row over the bound is enough to know, and all that is ever placed
        rows = frame.orderBy(*order).limit(max_rows + 1)
        placed = rows.select(F.row_number().over(Window.orderBy(*order)).alias("_p"), F.struct(*frame.columns).alias("_r"))
        body = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_r"))), lambda x: x["_r"]))
        over = F.raise_error(F.lit(f"section {name} has more than {max_rows} rows")).cast("string")
        parts.append(placed.agg(F.when(F.count(F.lit(1)) > max_rows, over).otherwise(body).alias("js"))
                           .select(F.lit(k).alias("k"), F.concat(F.lit(json.dumps(name) + ":"), "js").alias("js")))
    texts = functools.reduce(DataFrame.unionByName, parts)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "js"))), lambda x: x["js"]), ",")
    return texts.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("data"))
