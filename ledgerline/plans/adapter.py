"""The driver's tables as a log, entities, documents, streams and deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import chain_hash, payload_hash
from ..operators.ordered import last_before, numbered
from ..storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the chained logs of four projects; user_id and value stay for the folds."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("project_id"), F.col("event_id").alias("arrival"), F.col("event_id").cast("string").alias("event_id"), "event_type", "user_id", "value", F.col("props").alias("payload"), "ts"
    )
    rows = numbered(rows, ["project_id"], ["arrival"]).drop("arrival")
    # hashes don't compress: they are made when the rows are where they are written
    rows = last_before(rows, ["project_id"], "sequence_number", chain_hash(hashed=payload_hash()), "previous_hash", in_order=True)
    return rows.withColumn("payload_hash", payload_hash()).select("project_id", "sequence_number", "event_id", "event_type", "user_id", "value", "payload", "payload_hash", "previous_hash", "ts")


_stored: dict[tuple, tuple[str, StructType]] = {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ingested`` as a stored table by project, its files in the order of numbers, so that filters on both prune. It is written once a session for a table's files; all queries scan it."""
    key = (spark.sparkContext.applicationId, *sorted(table(spark, sf_dir, "events").inputFiles()))
    if key not in _stored:
        rows = ingested(spark, sf_dir)
        path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("project_id", "sequence_number").write.partitionBy("project_id").option("compression", "zstd").parquet(path)
        _stored[key] = path, rows.schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir)


def crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as changes of users."""
    kind = F.create_map(*map(F.lit, ("signup", "created", "purchase", "updated", "click", "updated", "error", "deleted")))
    rows = log(spark, sf_dir).withColumns({"entity_id": F.col("user_id").cast("string"), "kind": kind[F.col("event_type")]}).filter("kind is not null")
    return rows.withColumn("event_type", F.concat(F.lit("user."), "kind"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as document events with the payloads that applications write: content on create, updates on update."""
    rows = crud(spark, sf_dir).withColumn("event_type", F.concat(F.lit("document."), "kind"))
    one = F.struct(F.col("entity_id").alias("document_id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), F.struct(F.parse_json("payload").alias("props"), F.col("sequence_number").alias("first")).alias("content"))
    two = F.struct(F.col("entity_id").alias("document_id"), F.struct(F.parse_json("payload").alias("props"), F.col("sequence_number").alias("last")).alias("updates"))
    three = F.struct(F.col("entity_id").alias("document_id"))
    payload = F.when(F.col("kind") == "created", F.to_json(one)).when(F.col("kind") == "updated", F.to_json(two)).otherwise(F.to_json(three))
    return rows.select("project_id", "sequence_number", "event_id", "event_type", payload.alias("payload"), payload_hash(payload).alias("payload_hash"), "ts")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as entities with JSON data."""
    c = table(spark, sf_dir, "customer")
    born = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") % 97)
    data = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")).alias("account"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")))
    return c.select(F.col("c_custkey").alias("id"), data.alias("data"), F.lit(False).alias("deleted"), born.alias("created_at"), (F.col("c_custkey") % 5).alias("version"))


def deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of eight streams, and the receipts of three in four of them."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("stream-"), (F.col("user_id") % 8).cast("string")).alias("stream_id"), F.col("event_id").alias("velocity_seq"), "event_type")
    return e, e.filter("velocity_seq % 4 <> 0").withColumn("wal_sequence", F.col("velocity_seq") * 2)


def stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log as messages of streams named by type, and offsets committed by three groups."""
    rows = log(spark, sf_dir)
    messages = rows.select("project_id", F.col("event_type").alias("stream"), F.col("sequence_number").alias("offset"), "ts", "value")
    commits = rows.filter("sequence_number % 50 = 0").select("project_id", F.col("event_type").alias("stream"), F.concat(F.lit("group-"), (F.col("user_id") % 3).cast("string")).alias("consumer_group"), F.col("sequence_number").alias("offset"), "sequence_number")
    return messages, commits
