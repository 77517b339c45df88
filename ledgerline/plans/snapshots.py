"""Snapshots of tenant states as stored tables: written, listed, restored and checked against the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

MANIFEST = "snapshot_id string, created_at timestamp, up_to long, tenants long, events long"


def write(log: DataFrame, path: str, snapshot_id: str, created_at, up_to: int | None = None) -> None:
    """The tenants' states up to ``up_to``, and a row of the manifest; a snapshot that is written again replaces itself."""
    state = views.tenant_state(log, up_to)
    state.write.mode("overwrite").parquet(f"{path}/states/snapshot_id={snapshot_id}")
    stored = log.sparkSession.read.parquet(f"{path}/states/snapshot_id={snapshot_id}")
    row = stored.agg(F.count("*").alias("tenants"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.max("last_sequence").alias("last"))
    row = row.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(created_at).cast("timestamp").alias("created_at"), F.coalesce(F.lit(up_to).cast("long"), "last").alias("up_to"), "tenants", "events")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{snapshot_id}")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, newest first."""
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest")
    return rows.orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def latest(spark: SparkSession, path: str) -> str | None:
    row = listed(spark, path).first()
    return row and row.snapshot_id


def restore(spark: SparkSession, path: str, snapshot_id: str, log: DataFrame | None = None) -> DataFrame:
    """The states as they were written; with a log, carried on by its later events."""
    states = spark.read.parquet(f"{path}/states/snapshot_id={snapshot_id}")
    if log is None:
        return states
    row = listed(spark, path).filter(F.col("snapshot_id") == snapshot_id).first()
    return views.advanced(states, log.filter(F.col("sequence_number") > row.up_to))


def faults(spark: SparkSession, path: str, snapshot_id: str, log: DataFrame) -> DataFrame:
    """Tenants whose stored state isn't that of the log up to the snapshot's sequence; no rows if it is sound."""
    row = listed(spark, path).filter(F.col("snapshot_id") == snapshot_id).first()
    return views.snapshot_diff(restore(spark, path, snapshot_id), views.tenant_state(log, row.up_to))


def delete(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """Removes a snapshot's state and its row of the manifest; False if there was none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/states/snapshot_id={snapshot_id}", f"{path}/manifest/{snapshot_id}")]
    return all([p.getFileSystem(conf).delete(p, True) for p in gone])
