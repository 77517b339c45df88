import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import hashing
from ledgerline.functions.canonical import canonical
from ledgerline.operators import log, ordered
from ledgerline.sources import files


def rows(spark, counts):
    data = [(p, f"{p}-{k}", "item.created", json.dumps({"k": k}, separators=(",", ":")), f"2024-01-01 00:00:{k // 3:02d}", k) for p, n in counts.items() for k in range(n)]
    return spark.createDataFrame(data, "project_id string, event_id string, event_type string, payload string, t string, arrival long").withColumn("ts", F.to_timestamp("t")).drop("t")


def empty_log(spark):
    return spark.createDataFrame([], "project_id string, sequence_number long, event_id string, event_type string, payload string, payload_hash string, previous_hash string, ts timestamp")


def test_append_isolates_projects_and_chains(spark):
    whole = log.append(empty_log(spark), rows(spark, {"a": 7, "b": 3})).persist()
    assert {(r.project_id, r.head, r.events) for r in log.heads(whole).collect()} == {("a", 7, 7), ("b", 3, 3)}
    assert all(r.ok and r.gaps == 0 for r in log.verification(whole).collect())
    times = [r.ts for r in log.read_events(whole, "a").orderBy("sequence_number").collect()]
    assert all(x < y for x, y in zip(times, times[1:], strict=False))
    more = whole.unionByName(log.append(whole, rows(spark, {"a": 2}).withColumn("event_id", F.concat("event_id", F.lit("x")))))
    assert all(r.ok and r.gaps == 0 for r in log.verification(more).collect())
    assert log.heads(more).filter("project_id = 'a'").first().head == 9


def test_tampering_shows(spark):
    whole = log.append(empty_log(spark), rows(spark, {"a": 6}))
    bad = whole.withColumn("payload", F.when(F.col("sequence_number") == 3, '{"k":99}').otherwise(F.col("payload")))
    assert log.verification(bad).first().bad_hashes == 1
    assert [r.faults for r in log.faults(bad).orderBy("sequence_number").collect()][2] == ["payload_hash"]
    hashed = bad.withColumn("payload_hash", hashing.payload_hash())
    seen = log.chain(hashed).filter("broken").collect()
    assert [r.sequence_number for r in seen] == [4]


@pytest.mark.parametrize("n,offset,limit", [(3, 2, 1), (10, 4, 0), (5, 6, 2), (0, 1, 1)])
def test_reading(spark, n, offset, limit):
    whole = log.append(empty_log(spark), rows(spark, {"a": n, "b": 2}))
    got = [r.sequence_number for r in log.read_events(whole, "a", offset, limit=limit).collect()]
    want = list(range(offset, n + 1))
    assert sorted(got) == (want[:limit] if limit else want)
    with pytest.raises(ValueError):
        log.read_events(whole, "a", -1)


def test_faults(spark):
    odd = spark.createDataFrame([("bad id", 0, "", "a b", "{", "x"), ("p", 1, "e", "a.b", "{}", hashing_of("{}"))], "project_id string, sequence_number long, event_id string, event_type string, payload string, payload_hash string")
    assert [set(r.faults) for r in log.faults(odd).collect()] == [{"event_id", "project_id", "event_type", "payload", "sequence_number", "payload_hash"}, set()]


def hashing_of(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_last_before_over_blocks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), k, rng.choice([None, k])) for k in rng.sample(range(2000), 500)]
    df = spark.createDataFrame(data, "p string, s long, v long")
    got = {(r.p, r.s): r.q for r in ordered.last_before(df, ["p"], "s", F.col("v"), "q", block=64).collect()}
    want, last = {}, {}
    for p, s, v in sorted(data, key=lambda r: r[1]):
        want[p, s] = last.get(p)
        last[p] = v if v is not None else last.get(p)
    assert got == want


def test_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 9, 7]] + [(None,)], "x double")
    assert {(r.share, r.value) for r in ordered.at_ranks(df, "x", [0.5, 1.0, 0.0]).collect()} == {(0.5, 5.0), (1.0, 9.0), (0.0, 1.0)}
    assert ordered.at_ranks(df.filter("x > 100"), "x", [0.5]).count() == 0


def test_sound_prefix_and_replays(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 1, 0)], "project_id string, line long, bad int")
    assert {(r.project_id, r.line) for r in log.sound_prefix(df, "line", F.col("bad") == 1).collect()} == {("a", 1), ("b", 1)}
    assert log.same_replays(df, df).count() == 0
    assert log.state_hash(df, ["project_id"]).collect() == log.state_hash(df.orderBy(F.desc("line")), ["project_id"]).collect()
    one, two = ({r.project_id: r.state_hash for r in log.state_hash(x, ["project_id"]).collect()} for x in (df, df.repartition(3)))
    assert one == two


def test_scalar_functions(spark):
    r = spark.range(1).select(
        F.crc32(F.lit("123456789")).alias("crc"), hashing.tenant_partition(F.lit("tenant-1")).alias("p"), hashing.audit_action(F.lit("a.b.c")).alias("act"),
        hashing.sortable_id(F.lit(1766313417681275400), F.lit("0a1b2c3d4e")).alias("id"), hashing.backoff_ms(100, F.lit(4)).alias("b"), hashing.backoff_ms(100, F.lit(12)).alias("c"), hashing.index_key(F.lit(None)).alias("k"),
    ).first()
    h = 5381
    for c in "tenant-1":
        h = (h * 33 + ord(c)) % (1 << 32)
    assert (r.crc, r.p, r.act, r.b, r.c, r.k) == (3421780262, h % 16, "A_B.C", 1600, 30_000, "__null__")
    assert len(r.id) == 24
    assert int(r.id[:16], 16) == 1766313417681275400


def test_canonical_json():
    assert canonical('{"b": 1.50, "a": [1e21, 1e-7, 9007199254740993, "<é>", true, null]}') == '{"a":[1e+21,1e-07,9007199254740992,"\\u003cé\\u003e",true,null],"b":1.5}'
    assert canonical("{") is None
    assert canonical('{"x":{"b":1,"a":2}}') == canonical('{ "x" : { "a" : 2, "b" : 1 } }')


def test_lines(spark, tmp_path):
    whole = log.append(empty_log(spark), rows(spark, {"a": 4, "b": 2}))
    files.write_lines(whole, str(tmp_path / "lines"))
    back = files.read_log(spark, str(tmp_path / "lines"))
    assert back.count() == 6
    assert all(r.ok for r in log.verification(back).collect())
    (tmp_path / "torn").write_text((next((tmp_path / "lines").rglob("*.txt"))).read_text() + '{"event_id":"x","payl\n')
    seen = files.read_lines(spark, str(tmp_path / "torn"))
    assert seen.filter("corrupt").count() == 1


@pytest.mark.parametrize("version", [1, 2])
def test_segments(spark, tmp_path, version):
    events = [(k, 1_700_000_000_000_000 + k, f"t{k % 2}", "item.created", json.dumps({"id": f"ü{k}"}).encode()) for k in range(1, 9)]
    body = files.encode_segment(events, version)
    (tmp_path / "good.seg").write_bytes(body)
    (tmp_path / "torn.seg").write_bytes(body[:-3])
    flipped = bytearray(body)
    flipped[-1] ^= 1
    (tmp_path / "bad.seg").write_bytes(bytes(flipped))
    (tmp_path / "other.seg").write_bytes(b"nothing here" * 10)
    got = files.read_segments(spark, str(tmp_path)).withColumn("name", F.regexp_extract("segment", r"(\w+)\.seg$", 1)).collect()
    by = {n: [r for r in got if r.name == n] for n in ("good", "torn", "bad", "other")}
    assert [len(by[n]) for n in ("good", "torn", "bad", "other")] == [8, 7, 8, 0]
    assert all(r.valid for r in by["good"] + by["torn"])
    assert [r.valid for r in sorted(by["bad"], key=lambda r: r.sequence_number)] == [True] * 7 + [False]
    assert {(r.sequence_number, r.project_id, bytes(r.payload)) for r in by["good"]} == {(e[0], e[2], e[4]) for e in events}
    assert struct.unpack_from("<I", body, 56)[0] == zlib.crc32(body[:56])


def test_json_documents(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"id": "1", "project_id": "p", "collection": "c", "content": {"a": 1}, "version": 2}')
    (tmp_path / "p" / "2.json").write_text("{oops")
    got = files.read_documents(spark, str(tmp_path)).collect()
    assert sorted((r.id or "", r.corrupt is None) for r in got) == [("", False), ("1", True)]
