"""The joins of exactly-once delivery: events, receipts and what is still pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import last_before

KEY = ["stream_id", "velocity_seq"]


def undelivered(events: DataFrame, receipts: DataFrame) -> DataFrame:
    return events.join(receipts, KEY, "left_anti")


def known_receipts(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """The receipt of each event that has been delivered before."""
    return events.select(*KEY).join(receipts, KEY)


def pending(pushed: DataFrame, tombstones: DataFrame) -> DataFrame:
    return pushed.join(tombstones, KEY, "left_anti")


def recovery(pending_events: DataFrame, receipts: DataFrame) -> DataFrame:
    """What to do with each pending event after a crash: ``skip`` if it has a receipt, else ``redeliver``."""
    found = pending_events.join(receipts.select(*KEY, F.lit(True).alias("__seen")).distinct(), KEY, "left")
    return found.withColumn("action", F.when(F.col("__seen"), "skip").otherwise("redeliver")).drop("__seen")


def gate(events: DataFrame, crossed: DataFrame | None = None) -> DataFrame:
    """Each event's ``status``, as a micro-batch is taken, in the order of its numbers: transient (not irreversible), accepted, duplicate (accepted before), reorder (before the first that was accepted) or gap.

    A stream that hasn't crossed anything (``crossed``: stream_id, last and, if known, first) starts at its least number, and then takes only the next one: accepted
    is the first arrival of each number in the unbroken run."""
    live = events.filter("irreversibility_marker and velocity_seq > 0")
    if crossed is None:
        crossed = events.sparkSession.createDataFrame([], "stream_id string, last long")
    if "first" not in crossed.columns:
        crossed = crossed.withColumn("first", F.lit(None).cast("long"))
    first = live.groupBy(*KEY).agg(F.min("arrival").alias("accepted_at"))
    start = live.groupBy("stream_id").agg(F.min("velocity_seq").alias("least")).join(crossed, "stream_id", "left").select("stream_id", F.coalesce(F.col("last") + 1, "least").alias("start"), "first")
    seen = first.join(start.drop("first"), "stream_id").filter(F.col("velocity_seq") >= F.col("start"))
    seen = last_before(seen, ["stream_id"], "velocity_seq", F.col("velocity_seq"), "before")
    stop = seen.filter(F.coalesce("before", F.col("start") - 1) != F.col("velocity_seq") - 1).groupBy("stream_id").agg(F.min("velocity_seq").alias("stop"))
    good = seen.join(stop, "stream_id", "left").filter(F.col("stop").isNull() | (F.col("velocity_seq") < F.col("stop"))).select(*KEY, "accepted_at")
    out = events.join(good, KEY, "left").join(start, "stream_id", "left")
    status = (
        F.when(~F.coalesce("irreversibility_marker", F.lit(False)) | ~(F.col("velocity_seq") > 0), "transient")
        .when(F.col("accepted_at") == F.col("arrival"), "accepted")
        .when(F.col("accepted_at").isNotNull(), "duplicate")
        .when((F.col("velocity_seq") < F.col("start")) & F.coalesce(F.col("velocity_seq") >= F.col("first"), F.lit(False)), "duplicate")
        .when(F.col("velocity_seq") < F.col("start"), "reorder")
        .otherwise("gap")
    )
    return out.withColumn("status", status).drop("accepted_at", "start", "first")


def with_receipts(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each event with the log sequence of its first receipt; one that was delivered before gets the original's, a new one null."""
    original = receipts.groupBy(*KEY).agg(F.min("wal_sequence").alias("wal_sequence"))
    return events.join(original, KEY, "left")


def pending_in_order(pushed: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """What isn't acknowledged, by stream and number."""
    return pending(pushed, acknowledged).orderBy(*KEY)


def delivered_numbers(receipts: DataFrame, stream: str) -> DataFrame:
    """The numbers of a stream that were delivered, rising."""
    return receipts.filter(F.col("stream_id") == stream).select("velocity_seq").distinct().orderBy("velocity_seq")


def metrics(gated: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """(stream_id, received, delivered, rejected, duplicates, buffered, last_crossed) from events with their ``status``; ``waiting``: what is still buffered."""
    status = F.col("status")
    out = gated.groupBy("stream_id").agg(
        F.count("*").alias("received"),
        F.count_if(status == "accepted").alias("delivered"),
        F.count_if(status.isin("transient", "gap", "reorder")).alias("rejected"),
        F.count_if(status == "duplicate").alias("duplicates"),
        F.max(F.when(status == "accepted", F.col("velocity_seq"))).alias("last_crossed"),
    )
    if waiting is None:
        return out.withColumn("buffered", F.lit(0).cast("long"))
    held = waiting.groupBy("stream_id").agg(F.count("*").alias("buffered"))
    return out.join(held, "stream_id", "left").withColumn("buffered", F.coalesce("buffered", F.lit(0)))


def backpressure(levels: DataFrame, order: str, level: str, high: int = 80_000, low: int = 40_000) -> DataFrame:
    """Whether each moment is under pressure: from ``high`` on, until ``low`` or less."""
    mark = F.when(F.col(level) >= high, F.lit(True)).when(F.col(level) <= low, F.lit(False))
    rows = last_before(levels.withColumn("__all", F.lit(1)), ["__all"], order, mark, "__was")
    return rows.withColumn("pressed", F.coalesce(mark, "__was", F.lit(False))).drop("__all", "__was")
