"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private temporary folder only where none is set (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so that a lost executor costs no recomputation and values such as row ids stay as they were first computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``staged`` wrote, once everything read from it is written in turn, and let Spark's cleaner remove the shuffle files of jobs that are done: it does so when the driver collects garbage."""
    for df in tables:
        jvm, at = df.sparkSession._jvm, df._staged_at
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
