"""The log's stored table, and what its making shuffles."""

from pyspark.sql import functions as F

from ledgerline.functions import hashing
from ledgerline.operators import log, ordered
from ledgerline.plans import adapter

SMALL = "/root/testdata/sf0.001"


def test_last_before_in_order(spark):
    rows = spark.createDataFrame([(p, k, f"v{k}" if k % 7 == 0 else None) for p in "ab" for k in range(1, 60)], "p string, k long, v string").repartition(5)
    got = ordered.last_before(rows, ["p"], "k", F.col("v"), "was", block=8, in_order=True)
    assert {(r.p, r.k): r.was for r in got.collect()} == {(p, k): f"v{(k - 1) // 7 * 7}" if k > 7 else None for p in "ab" for k in range(1, 60)}
    ends = got.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("p", "k")).alias("a"), F.max(F.struct("p", "k")).alias("z")).orderBy("part").collect()
    assert all(x.z < y.a for x, y in zip(ends, ends[1:], strict=False))


def test_making_the_log_shuffles_its_rows_once_more(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = adapter.ingested(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.splitlines()
    assert plan.count("Exchange rangepartitioning") == 1
    # what else is shuffled holds no whole rows
    assert not any("payload" in below for line, below in zip(lines, lines[1:], strict=False) if "Exchange hashpartitioning" in line)
    rows = sorted(adapter.log(spark, SMALL).collect(), key=lambda r: (r.project_id, r.sequence_number))
    for a, b in zip([None, *rows], rows, strict=False):
        first = a is None or a.project_id != b.project_id
        assert b.sequence_number == (1 if first else a.sequence_number + 1)
        if first:
            assert b.previous_hash is None
    checked = adapter.log(spark, SMALL)
    assert all(r.ok and r.gaps == 0 for r in log.verification(checked).collect())
    assert checked.filter(hashing.payload_hash() != F.col("payload_hash")).count() == 0


def test_same_replays_counts_what_is_missing(spark):
    one = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "n long, h string")
    two = spark.createDataFrame([(1, "x"), (3, "z"), (3, "z"), (4, None)], "n long, h string")
    got = log.same_replays(one, two)
    assert sorted(map(str, got.collect())) == sorted(map(str, one.exceptAll(two).withColumn("only_in", F.lit(1)).unionByName(two.exceptAll(one).withColumn("only_in", F.lit(2))).collect()))
    # each replay's rows are grouped once
    assert log.same_replays(one, two)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
