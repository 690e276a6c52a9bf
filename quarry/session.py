"""Session helpers: a tuned builder, and a scratch folder that every executor can reach."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What Spark puts into one Arrow batch for Python, where the session doesn't say, and the bytes of a row group of tables in between.
ARROW, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROW_GROUP = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "4"}
ROOT = str(Path(__file__).resolve().parent.parent)
_scratch: dict[str, str] = {}


def get_spark(app: str = "quarry", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with adaptive execution, Arrow and a UTC clock; on a cluster the master comes from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start from now on import this package, from wherever the driver runs, and bounds the bytes of Arrow batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if ARROW not in spark.conf.getAll:
        spark.conf.set(ARROW, str(BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(_remove, _scratch[app])
    return "file://" + _scratch[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """The files there are deleted when the application ends; until then results may still read them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation.

    Row groups are small, since a task reads nested columns of large rows a row group at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression=codec, **ROW_GROUP).parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)
