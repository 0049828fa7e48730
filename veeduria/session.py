"""SparkSession construction and cluster-safe storage locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of the library wants: AQE re-plans joins and
# partition counts at runtime from real sizes, and splits skewed partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "veeduria",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides; locally
    pass ``local[N]``. Shuffle partitions default to Spark's own unless given;
    AQE coalesces them at runtime either way.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("VEEDURIA_DRIVER_MEMORY", "4g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder
    and is used as is. Only when it is unset (local tests) a scratch folder is
    created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="veeduria-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate table, under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + name


def reuse(df):
    """Compute ``df`` once for several consumers: written as a Parquet table
    in the shared checkpoint folder and read back (lineage cut, survives
    executor loss, computed once; the read keeps pushdown and pruning).
    Catalyst would otherwise push each consumer's filters and column
    pruning into ``df`` and plan it once per consumer."""
    import uuid

    path = scratch_table_dir(df.sparkSession, f"reuse_{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df) -> None:
    """Delete the scratch tables that ``df`` reads, once nothing needs them."""
    spark = df.sparkSession
    tables = scratch_table_dir(spark, "")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/reuse_" in folder and tables.rstrip("/").rpartition("/")[2] in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def move_folder(spark: SparkSession, src: str, dst: str) -> bool:
    """Let a folder that was written aside appear at ``dst``, whole; False if
    there is none."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (src, dst))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(a):
        return False
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{src} could not be moved to {dst}")
    return True
