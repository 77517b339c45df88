"""The pipeline's stages, one after the other, on a small table."""

from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the small tables")
def test_stages(spark):
    from ledgerline.llm import decontaminate, jaccard, secrets
    from ledgerline.storage import staged

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == before.columns
        after[name] = docs
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    good, single, clean, safe = after.values()
    groups = {r.component_id for r in jaccard.similar_groups(good).collect()}
    assert {r.doc_id for r in single.select("doc_id").collect()} == groups
    hit = decontaminate.contamination(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).filter("contaminated")
    assert clean.count() == single.count() - hit.count()
    assert safe.count() == clean.count()
    assert secrets.scans(safe).filter("n_secrets > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, safe, SMALL)
    assert last.count() == safe.count()
    assert last.filter("octet_length(ids) <> 4 * n_tokens").count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(1, "same words in a row here", "en", "a", 5), (1, "same words in a row here", "en", "a", 5), (2, None, None, None, None), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.without_secrets(spark, docs, "").count() == 4
    assert corpus_pipeline.encoded(spark, docs, "").count() == 4


def test_ids_reach_documents_without_a_shuffle_of_texts(spark):
    ids = [0, 1, 7, 8, 32_767, 32_768, -1, -32_768, -32_769, 2**63 - 1, -(2**63), 70_000]
    docs = spark.createDataFrame([(k, f"text {k}") for k in [*ids, 2, 9, 32_766, -2, 2**62, None, 7]], "doc_id long, text string")
    wanted = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    most, limit = corpus_pipeline.MOST_BITMAPS, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.with_ids(docs, wanted)
        assert sorted(r.doc_id for r in got.collect()) == sorted([*ids, 7]) and got.columns == docs.columns
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        corpus_pipeline.MOST_BITMAPS = 3
        assert sorted(r.doc_id for r in corpus_pipeline.with_ids(docs, wanted).collect()) == sorted([*ids, 7])
    finally:
        corpus_pipeline.MOST_BITMAPS = most
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
