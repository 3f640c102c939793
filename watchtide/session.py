"""Session settings and the small amount of run-time plumbing the operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join keys even when that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM never compiles longer methods, so what normalizes and enriches a row would be interpreted byte by byte
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# start-up settings; they only save time while plans are built
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "watchtide", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they may start anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_watchtide_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # not when the package itself runs from an archive that was shipped
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="watchtide-"), "watchtide"), "zip",
                                      os.path.dirname(here), os.path.basename(here))
        sc.addPyFile(archive)
    sc._watchtide_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to a
    temporary folder, because there every task sees the same disk.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="watchtide-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that takes what a query shuffled from the executors' disks when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Like :func:`cut_lineage`, for many rows: compressed columns, of which every later step reads only what it needs.

    What was shuffled on the way to them is no longer needed and goes from the disks as soon as they are written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, task_mb: int | None = None) -> DataFrame:
    """Use all cores when a small input arrives in fewer partitions than there are cores.

    Large inputs have many splits already and pass through unchanged.  Where every row is much work, ``task_mb``
    bounds the stored size of a task's rows instead: a split holds whole row groups, so its rows may be many or none.
    """
    cores = wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_mb:
        stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = max(cores, min(stored // (task_mb << 20), 20_000))
    if df.rdd.getNumPartitions() >= wanted and wanted == cores:
        return df
    # the non-deterministic filter keeps later filters above the exchange, where all cores evaluate them
    return df.repartition(wanted).where(F.spark_partition_id() >= 0)
