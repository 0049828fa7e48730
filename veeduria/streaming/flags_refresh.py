"""Incremental alert refresh over landed contract pages.

A file-source stream of landed JSON pages (``availableNow``). A record that
lands again replaces all earlier versions of its id. Each micro-batch:

1. normalises and derives the new records and writes them under
   ``contracts/batch_id=N/anio=Y`` (a replayed batch overwrites its own
   folders), in one pass over the landed text: records that are no valid
   contract, or could not be parsed, have no year and lie in their own folder;
   the latter are listed under ``rejected/batch_id=N``;
2. writes the (id, batch, year) versions that the new records replace under
   ``replaced/batch_id=N``, also where the new version is no valid contract;
3. recomputes only what the new and the replaced rows can change: F01, F04,
   F06 and F08 for their years, F02 for these years and the next (it compares
   with the previous calendar year), F03 for their buyers (its statistics
   span a buyer's whole history), F09 and F10 for the new rows;
4. writes the alerts under ``alerts/batch_id=N`` and the (flag, key) pairs it
   recomputed under ``manifest/batch_id=N``; the key is a year, or a buyer
   for F03.

Readers take, for every (flag, key), the alerts of the latest batch that
recomputed it, so a key whose alerts disappeared is replaced by nothing, and
the F09 and F10 alerts of rows not replaced. Display names of group alerts
are taken from the whole current table when alerts are read, so a rename
shows in years that no batch touched again.

Readers look replaced versions up in the folders (batch, year) that hold some;
all other rows are read as they are. Only years and folders are collected to the
driver. Records without an id never replace
each other; equal ids within one batch are different rows, as in a full run.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veeduria.operators import flags as FL
from veeduria.operators.derive import derive, derived, is_clean
from veeduria.operators.normalize import normalize
from veeduria.params import Params
from veeduria.schema import ALERT, CONTRACT
from veeduria.session import drop_written, reuse
from veeduria.sources.landed import CORRUPT, LANDED_SCHEMA, is_parsed

YEAR_FLAGS = ["F01", "F04", "F06", "F08"]
ROW_FLAGS = ["F09", "F10"]
_REPLACED = "id_contrato string, old_batch long, anio int, nit_entidad string"


def _contracts_schema(spark: SparkSession, p: Params) -> T.StructType:
    return derive(spark.createDataFrame([], CONTRACT), p).schema.add("batch_id", T.LongType())


def _replaced(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(f"{_REPLACED}, batch_id long").parquet(f"{out_dir}/replaced")


def _landed_rows(spark: SparkSession, out_dir: str, p: Params) -> DataFrame:
    """All records that batches wrote, those without a year too."""
    return spark.read.schema(_contracts_schema(spark, p).add(CORRUPT, T.StringType())).parquet(f"{out_dir}/contracts")


def _not_replaced(rows: DataFrame, r: DataFrame, once: bool = False) -> DataFrame:
    """``rows`` (id_contrato, batch_id, anio) without the versions in ``r``.
    Only rows of the batches and years that ``r`` names are joined; ``once``:
    what is left of these is written, for several consumers."""
    folders = [f"{b}/{y}" for b, y in r.select("old_batch", "anio").distinct().collect()]
    if not folders:
        return rows
    hit = F.concat_ws("/", "batch_id", "anio").isin(folders)
    r = r.select(F.col("id_contrato").alias("_id"), "old_batch")
    some = rows.where(hit)
    left = some.join(r, (some["id_contrato"] == r["_id"]) & (some["batch_id"] == r["old_batch"]), "left_anti")
    return rows.where(~hit).unionByName(reuse(left) if once else left)


def _versions(spark: SparkSession, out_dir: str, p: Params, below: int | None = None, columns: tuple[str, ...] = (),
              once: bool = False) -> DataFrame:
    """Contract rows that no batch (below ``below``) has replaced, or their
    ``columns`` beside id, batch and year."""
    c = _landed_rows(spark, out_dir, p).where(F.col("anio").isNotNull()).drop(CORRUPT)
    r = _replaced(spark, out_dir)
    if columns:
        c = c.select(*dict.fromkeys(("id_contrato", "batch_id", "anio", *columns)))
    if below is not None:
        c, r = c.where(F.col("batch_id") < below), r.where(F.col("batch_id") < below)
    return _not_replaced(c, r, once)


def contracts_table(spark: SparkSession, out_dir: str, p: Params = Params()) -> DataFrame:
    """The latest version of every contract loaded so far (``anio``
    partitions prune year filters)."""
    return _versions(spark, out_dir, p).drop("batch_id")


def current_alerts(spark: SparkSession, out_dir: str, p: Params = Params()) -> DataFrame:
    """Alert table as of the latest batch."""
    m = (spark.read.parquet(f"{out_dir}/manifest").groupBy("codigo", "clave")
              .agg(F.max("batch_id").alias("_b")))
    a = spark.read.parquet(f"{out_dir}/alerts")
    c = contracts_table(spark, out_dir, p)
    groups = (a.where(F.col("clave").isNotNull()).join(m, ["codigo", "clave"])
               .where(F.col("batch_id") == F.col("_b"))
               .drop("nombre_entidad", "proveedor")
               .join(FL.entity_labels(c).withColumnRenamed("ne", "nombre_entidad"), "nit_entidad", "left")
               .join(FL.supplier_labels(c).withColumnRenamed("pr", "proveedor"), "documento_proveedor", "left"))
    rows = _not_replaced(a.where(F.col("clave").isNull()), _replaced(spark, out_dir))
    names = [f.name for f in ALERT.fields]
    return groups.select(names).unionByName(rows.select(names))


#: What the flags of groups read of a contract, beside its year.
GROUP_COLUMNS = ("nit_entidad", "nombre_entidad", "documento_proveedor", "proveedor_adjudicado", "tipo_de_contrato",
                 "mes_firma", "valor_del_contrato", "es_sin_competencia", "es_persona_natural")


def _write_landed(batch: DataFrame, batch_id: int, out_dir: str, p: Params) -> None:
    """The landed records, parsed, cleaned and derived once."""
    rows = derived(normalize(batch, also=(CORRUPT,)), p)
    (rows.withColumn("anio", F.when(is_clean() & is_parsed(), F.col("anio")))
         .write.mode("overwrite").option("compression", "zstd").partitionBy("anio")
         .parquet(f"{out_dir}/contracts/batch_id={batch_id}"))


def _refresh(spark: SparkSession, batch_id: int, out_dir: str, p: Params) -> None:
    landed = _landed_rows(spark, out_dir, p)
    rows = landed.where(F.col("batch_id") == batch_id)
    # unparsed records have no year: the scan reads their folder only
    (rows.where(F.col("anio").isNull() & ~is_parsed()).select(F.col(CORRUPT).alias("registro"), "id_contrato")
         .write.mode("overwrite").parquet(f"{out_dir}/rejected/batch_id={batch_id}"))
    new = rows.where(F.col("anio").isNotNull()).drop("batch_id", CORRUPT)
    ids = rows.where(is_parsed() & F.col("id_contrato").isNotNull()).select("id_contrato")
    old = _versions(spark, out_dir, p, below=batch_id, columns=("nit_entidad",))
    if landed.where(F.col("batch_id") < batch_id).isEmpty():
        ids = ids.limit(0)                               # nothing to replace: the ids need not be moved
    (old.join(ids, "id_contrato", "left_semi")
        .select("id_contrato", F.col("batch_id").alias("old_batch"), "anio", "nit_entidad").distinct()
        .write.mode("overwrite").parquet(f"{out_dir}/replaced/batch_id={batch_id}"))
    gone = _replaced(spark, out_dir).where(F.col("batch_id") == batch_id)
    changed = new.select("anio", "nit_entidad").unionByName(gone.select("anio", "nit_entidad"))
    years = sorted(r[0] for r in changed.select("anio").distinct().collect())
    # written, so that its size decides the join before the contracts are moved for it
    buyers = reuse(changed.where(F.col("nit_entidad").isNotNull()).select("nit_entidad").distinct())
    y02 = sorted(set(years) | {y + 1 for y in years})
    # the current versions are found once for all flags, not by each flag and its labels
    c = _versions(spark, out_dir, p, columns=GROUP_COLUMNS, once=True)
    near = c.where(F.col("anio").isin(sorted({y + d for y in y02 for d in (-1, 0)})))
    own = c.join(buyers, "nit_entidad", "left_semi")
    by_year = [FL.REGISTRY[k].build(near.where(F.col("anio").isin(years)), p) for k in YEAR_FLAGS]
    by_year.append(FL.f02_jump(near, p).where(F.col("anio").isin(y02)))
    parts = [a.withColumn("clave", F.col("anio").cast("string")) for a in by_year]
    parts.append(FL.f03_spike(own, p).withColumn("clave", F.col("nit_entidad")))
    parts += [FL.REGISTRY[k].build(new, p).withColumn("clave", F.lit(None).cast("string")) for k in ROW_FLAGS]
    functools.reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(
        f"{out_dir}/alerts/batch_id={batch_id}")
    drop_written(c)
    keys = [(k, str(y)) for k in YEAR_FLAGS for y in years] + [("F02", str(y)) for y in y02]
    (spark.createDataFrame(keys, "codigo string, clave string")
          .unionByName(buyers.select(F.lit("F03").alias("codigo"), F.col("nit_entidad").alias("clave")))
          .write.mode("overwrite").parquet(f"{out_dir}/manifest/batch_id={batch_id}"))
    drop_written(buyers)


def rejected_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch_id, registro, id_contrato): landed records that could not be
    parsed, and the id read from them where there is one."""
    return spark.read.parquet(f"{out_dir}/rejected").select("batch_id", "registro", "id_contrato")


def _batch_writer(out_dir: str, p: Params):
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_landed(batch, batch_id, out_dir, p)
        _refresh(batch.sparkSession, batch_id, out_dir, p)
    return write


def run_refresh(spark: SparkSession, landed_dir: str, out_dir: str, checkpoint: str,
                p: Params = Params(), max_files_per_trigger: int | None = None) -> DataFrame:
    """Consume every landed page not yet processed, then return the current
    alert table."""
    # so that readers find the folder before the first batch
    spark.createDataFrame([], _REPLACED).write.mode("ignore").parquet(f"{out_dir}/replaced/batch_id=-1")
    r = spark.readStream.schema(LANDED_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (r.json(landed_dir).writeStream.foreachBatch(_batch_writer(out_dir, p))
          .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_alerts(spark, out_dir, p)
