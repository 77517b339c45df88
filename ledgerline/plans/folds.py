"""States as folds over the log, by aggregation alone: nothing walks an id's events in order, so one busy id is no long task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import last_before


def merged(changes: DataFrame, keys: list[str], payload: str = "payload", sequence: str = "sequence_number") -> DataFrame:
    """(keys, data): the JSON objects of each key merged in order, the later value of a top-level name winning; nested objects are replaced, JSON nulls kept. Names stand in their order."""
    names = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    one = changes.select(*keys, F.col(sequence).alias("__at"), F.explode(names).alias("__name", "__variant"))
    last = one.groupBy(*keys, "__name").agg(F.max_by(F.to_json("__variant"), "__at").alias("__value"))
    pairs = F.array_sort(F.collect_list(F.concat(F.to_json(F.struct(F.col("__name").alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("__name").alias("n")))) - 6), F.lit(":"), F.coalesce("__value", F.lit("null")))))
    return last.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("data"))


def entities(log: DataFrame, entity_type: str, entity_id: str | Column = "entity_id") -> DataFrame:
    """(project_id, id, data, created_at, updated_at, version, deleted, last_sequence), leniently: a create starts afresh and revives, updates of what's missing or deleted are ignored, deletes leave a tombstone, bad JSON and missing ids are ignored."""
    kinds = {f"{entity_type}.{k}{s}": k[0] for k, ends in (("create", "d"), ("update", "d"), ("delete", "d")) for s in ("", ends)}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    events = log.filter(F.col("event_type").isin(*kinds)).withColumns({"id": F.col(entity_id) if isinstance(entity_id, str) else entity_id, "__kind": kind[F.col("event_type")]})
    events = events.filter(F.col("id").isNotNull() & F.try_parse_json("payload").isNotNull()).select("project_id", "id", "sequence_number", "ts", "payload", "__kind")
    keys = ["project_id", "id"]
    born = events.filter("__kind = 'c'").groupBy(*keys).agg(F.max("sequence_number").alias("__born"))
    since = events.join(born, keys).filter("sequence_number >= __born")
    gone = since.filter("__kind = 'd'").groupBy(*keys).agg(F.min("sequence_number").alias("__gone"))
    since = since.join(gone, keys, "left")
    kept = since.filter("__kind <> 'd' and (__gone is null or sequence_number < __gone)")
    # every later delete sets the time again
    times = since.filter("__kind = 'd' or __gone is null or sequence_number < __gone").groupBy(*keys).agg(
        F.min_by("ts", "sequence_number").alias("created_at"), F.max_by("ts", "sequence_number").alias("updated_at"), F.count_if(F.col("__kind") != "d").alias("version"), F.max("__gone").isNotNull().alias("deleted"), F.max("sequence_number").alias("last_sequence")
    )
    return times.join(merged(kept, keys), keys, "left").select(*keys, F.coalesce("data", F.lit("{}")).alias("data"), "created_at", "updated_at", "version", "deleted", "last_sequence")


def document_events(log: DataFrame) -> DataFrame:
    """The log's document events as ``documents`` takes them, from payloads ``{document_id, collection, content}`` (created), ``{document_id, updates}`` (updated) and ``{document_id}``: document_id, collection, the content or updates as ``payload``, and ``invalid`` where a needed part is missing or empty."""
    doc = F.try_parse_json("payload")
    part = lambda name, kind="variant": F.try_variant_get(doc, f"$.{name}", kind)
    rows = log.filter(F.col("event_type").rlike(r"^document\.(created|updated|deleted)$"))
    named = rows.withColumns({"document_id": part("document_id", "string"), "collection": part("collection", "string"), "__content": F.to_json(part("content")), "__updates": F.to_json(part("updates"))})
    empty = lambda c: F.coalesce(c, F.lit("")).isin("", "null")
    created, updated = F.col("event_type") == "document.created", F.col("event_type") == "document.updated"
    invalid = empty(F.col("document_id")) | (created & (empty(F.col("collection")) | empty(F.col("__content")))) | (updated & (empty(F.col("__updates")) | (F.col("__updates") == "{}")))
    return named.withColumns({"invalid": F.coalesce(invalid, F.lit(True)), "payload": F.when(created, F.col("__content")).when(updated, F.col("__updates")).otherwise("{}")}).drop("__content", "__updates")


def document_steps(log: DataFrame, document_id: str | Column = "document_id") -> DataFrame:
    """The log's document events with ``kind`` (created, updated, deleted) and ``error``: a create of a live document (exists), an update of a missing one (missing), or one marked ``invalid``, which changes nothing. Deletes of missing ones are tolerated."""
    kind = F.regexp_extract("event_type", r"^document\.(created|updated|deleted)$", 1)
    steps = log.withColumns({"id": F.col(document_id) if isinstance(document_id, str) else document_id, "kind": kind}).filter("kind <> ''")
    wrong = F.col("invalid") if "invalid" in log.columns else F.lit(False)
    steps = last_before(steps, ["project_id", "id"], "sequence_number", F.when((F.col("kind") != "updated") & ~wrong, F.col("kind")), "__was")
    live = F.coalesce(F.col("__was") == "created", F.lit(False))
    error = F.when(wrong, "invalid").when((F.col("kind") == "created") & live, "exists").when((F.col("kind") == "updated") & ~live, "missing")
    return steps.withColumn("error", error).drop("__was")


def documents(log: DataFrame, document_id: str | Column = "document_id", strict: bool = False) -> DataFrame:
    """(project_id, id, content, created_at, updated_at, version, event_id) of the live documents, with their collection if the log has it; event_id is the creator's. Faulty steps are left out, or, if ``strict``, refused."""
    steps = document_steps(log, document_id)
    if strict and not steps.filter("error is not null").isEmpty():
        raise ValueError("the log has an invalid document event, creates a live document or updates a missing one")
    steps = steps.filter("error is null")
    keys = ["project_id", "id"]
    last = steps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "created", F.col("sequence_number"))).alias("__born"), F.max(F.when(F.col("kind") == "deleted", F.col("sequence_number"))).alias("__gone"))
    last = last.filter("__born is not null and (__gone is null or __gone < __born)").drop("__gone")
    now = steps.join(last, keys).filter("sequence_number >= __born")
    collection = [F.min_by("collection", "sequence_number").alias("collection")] if "collection" in log.columns else []
    state = now.groupBy(*keys).agg(
        *collection, F.min_by("ts", "sequence_number").alias("created_at"), F.max_by("ts", "sequence_number").alias("updated_at"), F.count("*").alias("version"), F.min_by("event_id", "sequence_number").alias("event_id")
    )
    return state.join(merged(now, keys), keys, "left").select(*keys, *(["collection"] if collection else []), F.coalesce("data", F.lit("{}")).alias("content"), "created_at", "updated_at", "version", "event_id")


def user_fold(log: DataFrame, keys: list[str], init: Callable[[], dict], apply: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A Python fold of each key's events in order: ``apply(state, event)`` from ``init()``; the state's items are the columns of ``schema``.

    A key's events come to one task, in batches: the state has to be small, and a fold that matters for busy keys should be written as an aggregation."""
    import json

    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        done: list[tuple] = []
        for pdf in batches:
            for event in pdf.to_dict("records"):
                own = tuple(event[k] for k in keys)
                if own != key:
                    if key is not None:
                        done.append((*key, json.dumps(state)))
                    key, state = own, init()
                state = apply(state, event)
            yield pd.DataFrame(done, columns=[*keys, "state"])
            done = []
        if key is not None:
            yield pd.DataFrame([(*key, json.dumps(state))], columns=[*keys, "state"])

    parts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*keys).schema.fields)
    # equal keys are neighbours in one partition, and come as a stream
    rows = log.repartition(*keys).sortWithinPartitions(*keys, "sequence_number")
    out = rows.mapInPandas(run, f"{parts}, state string")
    return out.select(*out.columns[:width], F.from_json("state", schema).alias("s")).select(*keys, "s.*")
