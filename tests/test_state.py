import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.values import Field
from ledgerline.operators import aggregate, delivery, find
from ledgerline.plans import folds, views

ROWS = [
    (1, '{"age":25,"city":"NYC","tags":["a"],"n":null}'), (2, '{"age":30,"city":"SF","ok":true}'), (3, '{"age":"25","city":"LA"}'), (4, '{"city":"NYC","in":{"x":5}}'), (5, "{}"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, data string")


@pytest.mark.parametrize(
    "condition,want",
    [
        (("age", "eq", 25), {1}), (("age", "eq", "25"), {3}), (("age", "ne", 25), {2, 3, 4, 5}), (("age", "gt", 1), {1, 2}), (("age", "lte", 25), {1}), (("n", "eq", None), {1}), (("ok", "eq", True), {2}),
        (("ok", "eq", 1), set()), (("in.x", "gte", 5), {4}), (("age.x", "eq", 1), set()), (("city", "in", ["SF", "LA", None]), {2, 3}), (("tags", "eq", ["a"]), {1}), (("age", "like", 2), set()), (("id", "in", [1, 5]), {1, 5}), (("city", "gt", "A"), set()),
    ],
)
def test_conditions(docs, condition, want):
    assert {r.id for r in docs.filter(find.where(*condition)).collect()} == want


def test_sorting_and_paging(docs):
    q = lambda: find.Query(docs).order_by("age")
    assert [r.id for r in q().rows().collect()] == [4, 5, 1, 2, 3]
    assert [r.id for r in find.Query(docs).order_by("age", "desc").rows().collect()] == [3, 2, 1, 4, 5]
    assert [r.id for r in q().offset(1).limit(2).rows().collect()] == [5, 1]
    assert q().offset(9).rows().count() == 0
    assert tuple(find.page_info(docs, 4, 2).first()) == (5, 1, False)
    assert tuple(find.page_info(docs, 9, 0).first()) == (5, 0, False)
    with pytest.raises(ValueError):
        q().limit(-1).rows()
    with pytest.raises(ValueError):
        q().order_by("age", "up")
    assert {r.id for r in find.Query(docs).between("age", 25, 30, include_high=False).rows().collect()} == {1}


@pytest.mark.parametrize("kind,field,want", [("count", None, 5), ("sum", "age", 55), ("avg", "age", 11), ("min", "age", 25), ("max", "age", 30), ("min", "city", float("inf")), ("max", "city", float("-inf"))])
def test_aggregates(docs, kind, field, want):
    assert find.Query(docs).aggregate(kind, field).first().value == want


@pytest.mark.parametrize("kind", ["count", "sum", "avg", "min", "max"])
def test_aggregates_of_nothing(docs, kind):
    assert aggregate.aggregated(docs.limit(0), kind, "age").first().value == 0


def test_missing_is_not_null(docs):
    got = {r.id: (r.p, r.t) for r in docs.select("id", Field("data", "n").present.alias("p"), Field("data", "age").number.alias("t")).collect()}
    assert got[1] == (True, 25.0)
    assert got[3] == (False, None)


def events(spark, rows):
    df = spark.createDataFrame([(p, i, s, f"e{s}", t, json.dumps(d) if isinstance(d, dict) else d) for p, i, s, t, d in rows], "project_id string, entity_id string, sequence_number long, event_id string, event_type string, payload string")
    return df.withColumns({"ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence_number")), "document_id": F.col("entity_id")})


def random_events(prefix, seed, n=400):
    rng = random.Random(seed)
    kinds = [f"{prefix}.created", f"{prefix}.updated", f"{prefix}.deleted", "other.kind"]
    out = []
    for s in range(1, n):
        t = rng.choices(kinds, [2, 4, 1, 1])[0]
        payload = {k: rng.choice([None, s, f"v{s}", {"deep": s}, [s], True]) for k in rng.sample(["a", "b", "c d", 'q"x'], rng.randint(0, 3))}
        out.append((rng.choice("pq"), f"i{rng.randint(0, 8)}", s, t, "{bad" if rng.random() < 0.02 else payload))
    return out


def test_entity_fold(spark):
    rows = random_events("item", 4)
    state = {}
    for p, i, s, t, d in rows:
        if not t.startswith("item.") or not isinstance(d, dict):
            continue
        old = state.get((p, i))
        if t == "item.created":
            state[p, i] = {"data": dict(d), "version": 1, "deleted": False}
        elif old and t == "item.updated" and not old["deleted"]:
            old["data"] |= d
            old["version"] += 1
        elif old and t == "item.deleted":
            old["deleted"] = True
    got = {(r.project_id, r.id): {"data": json.loads(r.data), "version": r.version, "deleted": r.deleted} for r in folds.entities(events(spark, rows), "item").collect()}
    assert got == state


def test_document_fold(spark):
    rows = [(p, i, s, t, d if isinstance(d, dict) else {}) for p, i, s, t, d in random_events("document", 9)]
    state, errors = {}, set()
    for p, i, s, t, d in rows:
        kind = t.removeprefix("document.")
        if kind == "created":
            if (p, i) in state:
                errors.add(s)
            else:
                state[p, i] = {"content": dict(d), "version": 1, "event": f"e{s}"}
        elif kind == "updated":
            if (p, i) in state:
                state[p, i]["content"] |= d
                state[p, i]["version"] += 1
            else:
                errors.add(s)
        elif kind == "deleted":
            state.pop((p, i), None)
    df = events(spark, rows)
    assert {(r.project_id, r.id): {"content": json.loads(r.content), "version": r.version, "event": r.event_id} for r in folds.documents(df).collect()} == state
    assert {r.sequence_number for r in folds.document_steps(df).filter("error is not null").collect()} == errors
    with pytest.raises(ValueError):
        folds.documents(df, strict=True)
    assert folds.documents(df.limit(0)).count() == 0


def test_user_fold(spark):
    df = events(spark, [("p", "i", s, "item.created", {"k": s}) for s in range(1, 40)] + [("q", "i", 1, "x", {})])
    out = folds.user_fold(df, ["project_id"], lambda: {"seen": []}, lambda st, e: {"seen": st["seen"] + [e["sequence_number"]]}, "seen array<long>")
    assert {r.project_id: r.seen for r in out.collect()} == {"p": list(range(1, 40)), "q": [1]}


def test_console_views(spark):
    log = spark.createDataFrame(
        [
            (1, "document.created", '{"document_id":"d1","collection":"c","content":{"a":1}}'), (2, "document.created", '{"document_id":"d2","collection":"c","content":{}}'), (3, "document.deleted", '{"document_id":"d1"}'), (4, "document.updated", '{"document_id":"d2","content":{"z":1}}'),
            (5, "cache.set", '{"key":"k","value":"1","ttl":5}'), (6, "cache.set", '{"key":"k","value":"2"}'), (7, "cache.set", '{"key":"gone","value":"2"}'), (8, "cache.deleted", '{"key":"gone"}'), (9, "message.published", '{"message_id":"m","payload":{"x":1}}'),
            (10, "file.uploaded", '{"file_id":"f","name":"n","size":2048}'), (11, "alert.created", '{"rule_id":"r","conditionField":"a"}'),
        ],
        "sequence_number long, event_type string, payload string",
    ).withColumns({"project_id": F.lit("p"), "payload_hash": F.lit("h"), "ts": F.current_timestamp()})
    assert [(r.id, r.content) for r in views.console_documents(log).collect()] == [("d2", "{}")]
    assert [(r.key, json.loads(r.payload)["value"]) for r in views.cache(log).collect()] == [("k", "2")]
    assert [(r.id, r.stream, r.offset) for r in views.messages(log).collect()] == [("m", None, 9)]
    assert views.files(log).first()["size"] == 2048
    assert views.alerts(log).first().active
    newest = views.audit(log).first()
    assert (newest.action, newest.entity) == ("ALERT_CREATED", "r")


def test_snapshot_and_tail(spark):
    df = events(spark, [("p" if s % 3 else "q", "i", s, f"t{s % 2}", {"k": s}) for s in range(1, 300)])
    whole = views.tenant_state(df)
    carried = views.advanced(views.tenant_state(df, 100), df.filter("sequence_number > 100"))
    assert views.snapshot_diff(whole, carried).count() == 0
    assert views.snapshot_diff(whole, views.tenant_state(df, 100)).count() == 2
    snap = views.snapshot(df, n=5).filter("project_id = 'p'").first()
    assert [e.sequence_number for e in snap.data["t1"]] == sorted(s for s in range(1, 300) if s % 3 and s % 2)[-5:]


def test_gate(spark):
    rows = [("a", k, k, True) for k in range(5, 9)] + [("a", 6, 100, True), ("a", 10, 101, True), ("b", 1, 1, False), ("b", 2, 2, True), ("c", 3, 3, True), ("c", 9, 4, True)]
    df = spark.createDataFrame(rows, "stream_id string, velocity_seq long, arrival long, irreversibility_marker boolean")
    got = {(r.stream_id, r.velocity_seq, r.arrival): r.status for r in delivery.gate(df, spark.createDataFrame([("c", 8)], "stream_id string, last long")).collect()}
    assert got == {
        ("a", 5, 5): "accepted", ("a", 6, 6): "accepted", ("a", 7, 7): "accepted", ("a", 8, 8): "accepted", ("a", 6, 100): "duplicate", ("a", 10, 101): "gap",
        ("b", 1, 1): "transient", ("b", 2, 2): "accepted", ("c", 3, 3): "reorder", ("c", 9, 4): "accepted",
    }


def test_streaming_bridge(spark, tmp_path):
    from ledgerline.streaming import bridge

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, schema = str(tmp_path / "in"), "stream_id string, velocity_seq long, irreversibility_marker boolean, event_type string, payload string"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        bridge.deliver(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), str(tmp_path / "check"), str(tmp_path / "receipts")).awaitTermination()

    send([(f"s{s}", k, True, "t", "{}") for s in range(3) for k in range(1, 21)])
    send([("s0", k, True, "t", "{}") for k in range(15, 31)] + [("s1", 25, True, "t", "{}"), ("s2", 21, False, "t", "{}")])
    got = spark.read.parquet(str(tmp_path / "out")).select("stream_id", "velocity_seq").collect()
    assert sorted(map(tuple, got)) == sorted([("s0", k) for k in range(1, 31)] + [(f"s{s}", k) for s in (1, 2) for k in range(1, 21)])
    assert spark.read.parquet(str(tmp_path / "receipts")).count() == 70
