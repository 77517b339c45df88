"""A training corpus from ``documents``, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, jaccard, quality, secrets
from ledgerline.llm.common import table
from ledgerline.llm.queries import quality_weights
from ledgerline.storage import staged

#: Bitmaps of 32,768 ids that are broadcast: 4 KB each.
MOST_BITMAPS = 4096


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``. Ids go to the documents as bitmaps, a bit each where they are dense, so that no text is shuffled; ids so sparse that there are more than ``MOST_BITMAPS`` are joined by a shuffle."""
    part, place = F.shiftright("doc_id", 15), F.col("doc_id").bitwiseAND(32767)
    maps = staged(ids.groupBy(part.alias("__part")).agg(F.bitmap_construct_agg(place).alias("__bits")), "kept-ids")
    if maps.count() > MOST_BITMAPS:
        return docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("__part", part).join(F.broadcast(maps), "__part")
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = quality.scorer(spark, quality_weights(spark, docs, sf_dir))
    return docs.filter(quality.predicted(score("text")) == 1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates, its row once; documents in no group stay, as do those without an id."""
    groups = staged(jaccard.similar_groups(docs).filter("doc_id is not null"), "groups")
    leaders = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = with_ids(docs.filter("doc_id is not null"), leaders.select("doc_id"))
    if not leaders.filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by a mark, and n_chars counts what is left."""
    return secrets.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as little-endian 32-bit numbers, with their count and their decoded text's SHA-256."""
    path = public_tokenizers.path("word_bpe_49k.json")
    code = bpe.tokenizer(bpe.ship_lexicon(docs, path), path)
    out = docs.select("doc_id", "lang", "source", code("text").alias("x"))
    return out.select("doc_id", "lang", "source", (F.octet_length("x.ids") / 4).cast("long").alias("n_tokens"), "x.ids", F.sha2("x.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't train the classifier; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
