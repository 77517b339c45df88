"""Views of the log that consoles, streams and snapshots show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import audit_action


def field(name: str, payload: str = "payload") -> Column:
    return F.get_json_object(payload, f"$.{name}")


def console_documents(log: DataFrame) -> DataFrame:
    """Created and not deleted since; updates don't show."""
    rows = log.filter(F.col("event_type").isin("document.created", "document.deleted")).withColumn("id", field("document_id"))
    last = rows.groupBy("project_id", "id").agg(F.max_by(F.struct("event_type", "payload", "payload_hash"), "sequence_number").alias("e"))
    return last.filter("e.event_type = 'document.created'").select("project_id", "id", field("collection", "e.payload").alias("collection"), field("content", "e.payload").alias("content"), F.col("e.payload_hash").alias("hash"))


def messages(log: DataFrame) -> DataFrame:
    """Published messages; one without a stream has a null stream."""
    return log.filter(F.col("event_type") == "message.published").select(
        "project_id", field("message_id").alias("id"), field("stream").alias("stream"), field("payload").alias("payload"), field("published_at").alias("published_at"), F.col("sequence_number").alias("offset")
    )


def cache(log: DataFrame, key: str | Column | None = None, sets: str = "cache.set", deletes: str = "cache.deleted") -> DataFrame:
    """The last value set under each key, unless deleted later."""
    key = field("key") if key is None else F.col(key) if isinstance(key, str) else key
    rows = log.filter(F.col("event_type").isin(sets, deletes)).withColumn("key", key)
    last = rows.groupBy("project_id", "key").agg(F.max_by(F.struct("event_type", "payload"), "sequence_number").alias("e"))
    return last.filter(F.col("e.event_type") == sets).select("project_id", "key", "e.payload")


def files(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event_type") == "file.uploaded").select("project_id", field("file_id").alias("id"), field("name").alias("name"), field("size").cast("long").alias("size"), field("type").alias("type"), field("uploaded_at").alias("uploaded_at"), F.col("payload_hash").alias("hash"))


def alerts(log: DataFrame) -> DataFrame:
    names = {"id": "rule_id", "source": "source", "condition_field": "conditionField", "condition_value": "conditionValue", "action": "action"}
    return log.filter(F.col("event_type") == "alert.created").select("project_id", *(field(v).alias(k) for k, v in names.items()), F.lit(True).alias("active"))


def audit(log: DataFrame) -> DataFrame:
    """One row an event, newest first; the entity is the first id that its payload has."""
    ids = [F.nullif(field(n), F.lit("")) for n in ("document_id", "message_id", "key", "file_id", "rule_id", "user_id", "order_id")]
    return log.select("project_id", "sequence_number", audit_action().alias("action"), F.coalesce(*ids, F.lit("unknown")).alias("entity"), "ts").orderBy(F.desc("sequence_number"), "project_id")


def tenant_state(log: DataFrame, up_to: int | None = None) -> DataFrame:
    """(project_id, event_count, last_event_at, last_sequence)."""
    log = log if up_to is None else log.filter(F.col("sequence_number") <= up_to)
    return log.groupBy("project_id").agg(F.count("*").alias("event_count"), F.max_by("ts", "sequence_number").alias("last_event_at"), F.max("sequence_number").alias("last_sequence"))


def last_per_type(log: DataFrame, n: int = 100) -> DataFrame:
    """The last n events of each project and type. A limit on the rank cuts each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy("project_id", "event_type").orderBy(F.desc("sequence_number")))
    return log.withColumn("place", place).filter(F.col("place") <= n)


def snapshot(log: DataFrame, up_to: int | None = None, n: int = 100) -> DataFrame:
    """``tenant_state`` with ``data``: the last n events of each type, in order."""
    log = log if up_to is None else log.filter(F.col("sequence_number") <= up_to)
    kept = last_per_type(log, n).groupBy("project_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("sequence_number", "ts", "payload"))).alias("events"))
    data = kept.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "events")))).alias("data"))
    return tenant_state(log).join(data, "project_id")


def advanced(base: DataFrame, tail: DataFrame) -> DataFrame:
    """A tenant state carried on by later events: the same as the state of the whole log."""
    both = base.unionByName(tenant_state(tail))
    return both.groupBy("project_id").agg(F.sum("event_count").alias("event_count"), F.max_by("last_event_at", "last_sequence").alias("last_event_at"), F.max("last_sequence").alias("last_sequence"))


def snapshot_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """Tenants whose states differ, or that only one side has."""
    a, b = one.alias("a"), two.alias("b")
    both = a.join(b, F.col("a.project_id") == F.col("b.project_id"), "full_outer")
    same = F.col("a.event_count").eqNullSafe(F.col("b.event_count")) & F.col("a.last_sequence").eqNullSafe(F.col("b.last_sequence")) & F.col("a.last_event_at").eqNullSafe(F.col("b.last_event_at"))
    return both.filter(~same).select(F.coalesce("a.project_id", "b.project_id").alias("project_id"), F.col("a.event_count").alias("events_one"), F.col("b.event_count").alias("events_two"))


def offsets(commits: DataFrame) -> DataFrame:
    """The last committed offset of each consumer group and stream."""
    return commits.groupBy("project_id", "stream", "consumer_group").agg(F.max_by("offset", "sequence_number").alias("committed"))


def lag(stream: DataFrame, commits: DataFrame, block: int = 65_536) -> DataFrame:
    """(project_id, stream, consumer_group, committed, waiting): messages behind each group's offset.

    Messages are counted by blocks of ``block`` offsets, with map-side combine; whole blocks behind an offset are summed from those counts, and only the messages of the
    blocks that hold an offset, one a group, are looked at one by one."""
    keys = ["project_id", "stream"]
    groups = offsets(commits).withColumn("__block", F.floor(F.col("committed") / block))
    rows = stream.select(*keys, "offset", F.floor(F.col("offset") / block).alias("__block"))
    counts = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("__block"))
    behind = counts.select(*keys, "__block", F.sum("__n").over(later).alias("__sum"))
    whole = groups.join(behind.withColumnRenamed("__block", "__from"), keys, "left").filter(F.col("__from") > F.col("__block"))
    whole = whole.groupBy(*keys, "consumer_group").agg(F.max("__sum").alias("__whole"))
    part = rows.join(groups, [*keys, "__block"]).filter(F.col("offset") > F.col("committed")).groupBy(*keys, "consumer_group").agg(F.count("*").alias("__part"))
    out = groups.drop("__block").join(whole, [*keys, "consumer_group"], "left").join(part, [*keys, "consumer_group"], "left")
    return out.select(*keys, "consumer_group", "committed", (F.coalesce("__whole", F.lit(0)) + F.coalesce("__part", F.lit(0))).alias("waiting"))


def replay(stream: DataFrame, name: str | None = None, from_offset: int | None = None, from_time=None) -> DataFrame:
    rows = stream if name is None else stream.filter(F.col("stream") == name)
    rows = rows if from_offset is None else rows.filter(F.col("offset") >= from_offset)
    return rows if from_time is None else rows.filter(F.col("ts") >= F.lit(from_time))


def rate_violations(log: DataFrame, most_per_second: int) -> DataFrame:
    """Seconds in which a project wrote more events than its quota."""
    per = log.groupBy("project_id", F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("events"))
    return per.filter(F.col("events") > most_per_second)


def dashboard(log: DataFrame) -> DataFrame:
    """(project_id, events, documents, messages, files, file_bytes): what a console's start page sums up."""
    kind = lambda name: F.count_if(F.col("event_type") == name)
    size = F.when(F.col("event_type") == "file.uploaded", field("size").cast("long"))
    return log.groupBy("project_id").agg(
        F.count("*").alias("events"),
        (kind("document.created") - kind("document.deleted")).alias("documents"),
        kind("message.published").alias("messages"),
        kind("file.uploaded").alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("file_bytes"),
    )


def usage(stream: DataFrame) -> DataFrame:
    return stream.groupBy("project_id").agg(F.countDistinct("stream").alias("streams"), F.countDistinct("consumer_group").alias("groups"), F.count("*").alias("events"))
