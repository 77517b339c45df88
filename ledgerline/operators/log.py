"""Reading, appending and checking the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.hashing import chain_hash, payload_hash
from ..schema import MOST_PAYLOAD, PROJECT_PATTERN, TYPE_PATTERN
from .ordered import last_before, numbered


def read_events(log: DataFrame, project: str | None = None, from_sequence: int = 0, to_sequence: int | None = None, types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Events of a project (all, if none) by sequence; limit 0 is all. Every condition reaches the scan."""
    if from_sequence < 0 or limit < 0:
        raise ValueError("from_sequence and limit can't be negative")
    if project is not None:
        log = log.filter(F.col("project_id") == project)
    if from_sequence:
        log = log.filter(F.col("sequence_number") >= from_sequence)
    if to_sequence is not None:
        log = log.filter(F.col("sequence_number") <= to_sequence)
    if types:
        log = log.filter(F.col("event_type").isin(*types))
    return log.orderBy("project_id", "sequence_number").limit(limit) if limit else log


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id").agg(F.max("sequence_number").alias("head"), F.count("*").alias("events"))


def last_events(log: DataFrame) -> DataFrame:
    """The last event of each project."""
    return log.groupBy("project_id").agg(F.max_by(F.struct(*log.columns), "sequence_number").alias("e")).select("e.*")


def segments(log: DataFrame, segment: str | Column) -> DataFrame:
    """(segment, first, last, events, checksum): the checksum is the XOR of the events' CRC-32."""
    return log.groupBy((F.col(segment) if isinstance(segment, str) else segment).alias("segment")).agg(
        F.min("sequence_number").alias("first_sequence"), F.max("sequence_number").alias("last_sequence"), F.count("*").alias("events"), F.bit_xor(F.crc32("payload")).alias("checksum")
    )


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (project_id, event_type, payload, ts, arrival, event_id) as log rows after the log's heads: sequence numbers, payload hashes, the hash of the previous event, and times that rise by a microsecond where they wouldn't. Rows that aren't valid must have been put aside by ``faults`` before."""
    base = last_events(log).select("project_id", F.col("sequence_number").alias("__seq"), F.col("ts").alias("__ts"), chain_hash().alias("__hash"))
    rows = numbered(new, ["project_id"], ["arrival"], "__n").join(base, "project_id", "left")
    rows = rows.withColumns({"sequence_number": F.coalesce("__seq", F.lit(0)) + F.col("__n"), "payload_hash": payload_hash()})
    # the running maximum of (time - place), plus the place, rises by one at least
    rows = rows.withColumn("__lag", F.unix_micros("ts") - F.col("sequence_number"))
    rows = _running_max(rows, "__lag", F.unix_micros("__ts") - F.col("__seq"))
    rows = last_before(rows, ["project_id"], "sequence_number", chain_hash(), "__previous")
    return rows.select(
        "project_id", "sequence_number", "event_id", "event_type", "payload", "payload_hash", F.coalesce("__previous", "__hash").alias("previous_hash"), F.timestamp_micros(F.col("__top") + F.col("sequence_number")).alias("ts")
    )


def _running_max(rows: DataFrame, value: str, start: Column, block: int = 1 << 16) -> DataFrame:
    """``__top``: the largest value up to the row in its project, and ``start``; in blocks, as in ``last_before``."""
    from pyspark.sql import Window

    rows = rows.withColumn("__block", F.expr(f"floor(sequence_number / {block})"))
    past = Window.partitionBy("project_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("project_id", "__block").agg(F.max(value).alias("__most")).withColumn("__handed", F.max("__most").over(past)).drop("__most")
    own = Window.partitionBy("project_id", "__block").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.max(value).over(own)).join(blocks, ["project_id", "__block"])
    return rows.withColumn("__top", F.greatest("__own", "__handed", start)).drop("__block", "__own", "__handed")


def faults(log: DataFrame) -> DataFrame:
    """The log with ``faults``: what is wrong with an event itself."""

    def named(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    checks = [
        named(F.length("event_id") == 0, "event_id"),
        named(~F.col("project_id").rlike(PROJECT_PATTERN), "project_id"),
        named(~F.col("event_type").rlike(TYPE_PATTERN), "event_type"),
        named(F.octet_length("payload") > MOST_PAYLOAD, "payload size"),
        named(F.try_parse_json("payload").isNull(), "payload"),
        named(F.col("sequence_number") <= 0, "sequence_number"),
        named(payload_hash() != F.col("payload_hash"), "payload_hash"),
    ]
    return log.withColumn("faults", F.array_compact(F.array(*checks)))


def chain(log: DataFrame) -> DataFrame:
    """The log with ``previous_sequence``, ``gap`` (a warning) and ``broken`` (the previous event's hash differs from previous_hash; a first event is never broken)."""
    rows = last_before(log, ["project_id"], "sequence_number", F.struct("sequence_number", chain_hash().alias("hash")), "__previous")
    return rows.select(
        *log.columns,
        F.col("__previous.sequence_number").alias("previous_sequence"),
        F.coalesce(F.col("sequence_number") != F.col("__previous.sequence_number") + 1, F.lit(False)).alias("gap"),
        F.coalesce(~F.col("previous_hash").eqNullSafe(F.col("__previous.hash")) & F.col("__previous").isNotNull(), F.lit(False)).alias("broken"),
    )


def verification(log: DataFrame) -> DataFrame:
    """(project_id, events, bad_hashes, gaps, broken, ok) for each project."""
    seen = chain(log).withColumn("bad", payload_hash() != F.col("payload_hash"))
    out = seen.groupBy("project_id").agg(F.count("*").alias("events"), F.count_if("bad").alias("bad_hashes"), F.count_if("gap").alias("gaps"), F.count_if("broken").alias("broken"))
    return out.withColumn("ok", (F.col("bad_hashes") == 0) & (F.col("broken") == 0))


def out_of_order(log: DataFrame, order: str, sequence: str = "sequence_number") -> DataFrame:
    """Events whose number isn't above that of the event before them in ``order`` (unique whole numbers) of the whole log, with ``previous``."""
    rows = last_before(log.withColumn("__all", F.lit(1)), ["__all"], order, F.col(sequence), "previous")
    return rows.filter(F.col(sequence) <= F.col("previous")).drop("__all")


def latest(log: DataFrame, n: int, project: str | None = None) -> DataFrame:
    """The last n events, newest first: a top-k."""
    rows = log if project is None else log.filter(F.col("project_id") == project)
    return rows.orderBy(F.desc("sequence_number"), "project_id").limit(n)


def progress(log: DataFrame, every: int = 1000) -> DataFrame:
    """(project_id, processed, current_sequence, last_event_time): what a replay has seen after each ``every`` events and at its end. Sequence numbers are gapless; a replay that stops at a fault is that of ``sound_prefix``."""
    step = F.floor((F.col("sequence_number") - 1) / every)
    parts = log.groupBy("project_id", step.alias("__step")).agg(F.max("sequence_number").alias("processed"), F.max_by("ts", "sequence_number").alias("last_event_time"))
    return parts.select("project_id", "processed", F.col("processed").alias("current_sequence"), "last_event_time")


def handled(log: DataFrame, handler: Callable[[Row], None], project: str | None = None, from_sequence: int = 0) -> int:
    """Calls ``handler`` with each event of a replay in order, a partition at a time on the driver, and returns how many. A handler for large logs should take frames (``foreachBatch``) instead."""
    n = 0
    for row in read_events(log, project, from_sequence).orderBy("project_id", "sequence_number").toLocalIterator():
        handler(row)
        n += 1
    return n


def sound_prefix(lines: DataFrame, line: str, bad: Column) -> DataFrame:
    """The lines of each project before its first bad one, as recovery after a torn write keeps them."""
    first = lines.filter(bad).groupBy("project_id").agg(F.min(line).alias("__first_bad"))
    return lines.join(first, "project_id", "left").filter(F.col("__first_bad").isNull() | (F.col(line) < F.col("__first_bad"))).drop("__first_bad")


def same_replays(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that only one of two replays has, each as often as it's missing."""
    both = one.withColumn("__more", F.lit(1)).union(two.withColumn("__more", F.lit(-1)))
    more = both.groupBy(*one.columns).agg(F.sum("__more").alias("__more")).filter("__more <> 0")
    return more.select(*one.columns, F.when(F.col("__more") > 0, 1).otherwise(2).alias("only_in"), F.explode(F.sequence(F.lit(1), F.abs("__more").cast("int"))).alias("__copy")).drop("__copy")


def state_hash(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: a hash of its rows that doesn't depend on their order. Each row is hashed by itself, and the hashes are summed."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, k * 15 + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    return df.groupBy(*key).agg(F.count("*").alias("rows"), *parts).select(*key, "rows", F.sha2(F.concat_ws(":", "rows", "h0", "h1"), 256).alias("state_hash"))
