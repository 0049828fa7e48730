"""A contract table with a load journal.

    table/data/load=<id>/anio=<year>/...     staged rows, never changed
    table/journal/version=<n>/...            (anio, load): what version n holds

A load stages its rows in a folder of its own, then commits: it writes the
next version of the journal, which lists for every year the staged folders
that hold it. The journal is written last and in one step (its ``_SUCCESS``
mark), so a load that is killed leaves the table as it was, and readers see
the last committed version whole, whatever is staged meanwhile. A load is
named by its caller; one that is already in the journal is not run again. Two
loads that commit the same version at once: the second one fails and can be
run again.

* ``rebuild`` (full load): the new rows alone.
* ``append`` (batch): the new rows beside the old ones.
* ``reload`` (dated load): the rows of [start, end) are replaced. Only the
  years that the range touches change; their rows outside the range are
  staged again with the new ones, all other years keep their folders.

A journal has a row per year and load, so it is read as a list; rows are
pruned by year at the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOURNAL = "anio int, load string, kind string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class Table:
    """A journalled table of rows with a year column ``anio``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if "anio" in schema.names else T.StructType([*schema.fields, T.StructField("anio", T.IntegerType())])

    # ---------------------------------------------------------------- reading
    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, p = _fs(self.spark, f"{self.path}/journal")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("version="))
                      if _exists(self.spark, f"{self.path}/journal/version={n}/_SUCCESS"))

    def journal(self, version: int | None = None) -> DataFrame:
        """(anio, load, kind) of a version, the last one by default."""
        n = max(self.versions(), default=None) if version is None else version
        if n is None:
            return self.spark.createDataFrame([], JOURNAL)
        return self.spark.read.schema(JOURNAL).parquet(f"{self.path}/journal/version={n}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a committed version."""
        held = [(r["anio"], r["load"]) for r in self.journal(version).collect() if r["load"]]
        folders = [self._folder(load, year) for year, load in held]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return (self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
                    .parquet(*folders).select(*self.schema.names))

    def _folder(self, load: str, year: int | None) -> str:
        return f"{self.path}/data/load={load}/anio={'__HIVE_DEFAULT_PARTITION__' if year is None else year}"

    # ---------------------------------------------------------------- loading
    def done(self, load: str) -> bool:
        """Whether any version has committed this load."""
        n = self.versions()
        if not n:
            return False
        marks = self.spark.read.schema(JOURNAL).parquet(*[f"{self.path}/journal/version={v}" for v in n])
        return not marks.where(F.col("kind").endswith(f":{load}")).isEmpty()

    def stage(self, rows: DataFrame, load: str) -> list[int | None]:
        """Write a load's rows, unseen by readers, and return their years."""
        folder = f"{self.path}/data/load={load}"
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy("anio").parquet(folder)
        try:
            staged = self.spark.read.schema(self.schema).parquet(folder)
            return [r["anio"] for r in staged.select("anio").distinct().collect()]
        except AnalysisException:           # a load without rows has no files
            return []

    def commit(self, entries: list[tuple[int | None, str]], kind: str, load: str) -> int:
        """Write the next version of the journal."""
        n = max(self.versions(), default=0) + 1
        # a row without a load marks the load as done, also if it had no rows
        rows = [(y, x, kind) for y, x in entries] + [(None, None, f"{kind}:{load}")]
        target = f"{self.path}/journal/version={n}"
        if _exists(self.spark, target) and not _exists(self.spark, f"{target}/_SUCCESS"):
            fs, p = _fs(self.spark, target)          # left by a commit that was killed
            fs.delete(p, True)
        self.spark.createDataFrame(rows, JOURNAL).coalesce(1).write.mode("errorifexists").parquet(target)
        return n

    def _held(self) -> list[tuple[int | None, str]]:
        return [(r["anio"], r["load"]) for r in self.journal().collect() if r["load"]]

    def rebuild(self, rows: DataFrame, load: str) -> None:
        """The table holds these rows only."""
        if not self.done(load):
            self.commit([(y, load) for y in self.stage(rows, load)], "rebuild", load)

    def append(self, rows: DataFrame, load: str) -> None:
        """These rows beside the others."""
        if not self.done(load):
            years = self.stage(rows, load)
            self.commit(self._held() + [(y, load) for y in years], "append", load)

    def reload(self, rows: DataFrame, load: str, start: str, end: str, col: str = "fecha_de_firma") -> None:
        """The rows with start <= ``col`` < end are replaced by those of
        ``rows`` in that range."""
        if self.done(load):
            return
        s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        inside = (F.col(col) >= s) & (F.col(col) < e)
        # of the last year only if the range goes into it
        first, last = int(start[:4]), (dt.datetime.fromisoformat(end) - dt.timedelta(microseconds=1)).year
        touched = F.col("anio").between(first, last)
        # of the touched years only the first and the last can have rows outside the range
        kept = self.read().where(touched & ~inside)
        years = self.stage(rows.where(inside).select(*self.schema.names).unionByName(kept), load)
        others = [(y, x) for y, x in self._held() if y is None or not first <= y <= last]
        self.commit(others + [(y, load) for y in years], "reload", load)
