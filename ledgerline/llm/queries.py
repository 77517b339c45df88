"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, langid, mixing, quality, repeats, secrets, sharding, topk
from .common import fold, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    digest = bpe.digests(bpe.ship_lexicon(docs, path), path)
    return docs.select("doc_id", digest("text").alias("x")).select("doc_id", "x.*")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scans(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    learnt = langid.train(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"), langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    lang = langid.identifier(spark, learnt)
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), lang("text").alias("x"))
    return out.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(documents(spark, sf_dir), fold("doc_id", 10) == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 24_000):
    """The quality model learnt from ``docs`` by the labels in ``sf_dir``: the held-out quarter of the keys plays no part."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter((fold("doc_id", 4) != 2) & F.col("label").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    few = quality.bounded_sample(labels, "doc_id", most)
    # what AQE finds small enough is broadcast, else both sides are shuffled
    return quality.train(docs.select("doc_id", "text").join(few, "doc_id"), most=most, n=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = quality.scorer(spark, quality_weights(spark, docs, sf_dir))
    docs = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score("text").alias("score"))
    return docs.withColumn("predicted", quality.predicted("score"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_topk, op2_repeats, op3_bpe, op4_secrets, op5_language, op6_decontaminate, op7_lm_scores, op8_sharding, op9_quality, op10_jaccard_join)}
