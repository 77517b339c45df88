"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where its scan would use a part of the cores only, as that of a single file does; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def fold(key: str | Column, n: int) -> Column:
    """``crc32(key as text) mod n``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def lower_ascii(text: str | Column) -> Column:
    """Only A-Z become small letters."""
    return F.translate(text, UPPER, LOWER)


def bounded_sample(df: DataFrame, key: str, most: int, n: int | None = None, of: str | None = None, counts: dict | None = None, least: int = 0) -> DataFrame:
    """Rows whose key's hash falls below a threshold set so that about ``most`` rows stay; all, if there are fewer. Depends on keys alone, not on partitions. ``n``: the row count where it's known.

    With ``counts``, the rows of each value of ``of``, a value whose share is under ``least`` rows keeps that many, or all it has."""
    n = sum(counts.values()) if counts is not None else df.count() if n is None else n
    if n <= most:
        return df
    steps = 1 << 20
    below = F.lit(max(1, steps * most // n))
    if counts:
        below = F.greatest(below, F.create_map(*(F.lit(x) for v, k in counts.items() for x in (v, min(steps, -(-steps * least // k)))))[F.col(of)])
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(steps)) < below)


def most_frequent(words: DataFrame, most: int, counts: bool = False) -> list:
    """The words of ``words`` (word, n) with the highest counts, ``most`` at most, in order; with ``counts`` as pairs. Steps of an eighth of an octave of counts are taken whole; of the step that has too many words, those whose hash is below a threshold for nine tenths of the room left. Only the chosen words come to the driver, and a number for each step before."""
    parts = 1 << 20
    steps = staged(words.withColumns({"step": F.floor(F.log2("n") * 8).cast("int"), "draw": F.pmod(F.xxhash64("word"), F.lit(parts))}), "word-counts")
    room, least, below = most, 1 << 30, 0
    for r in steps.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # 8 steps a doubling
        if r["words"] > room:
            least, below = r["step"] + 1, int(0.9 * room / r["words"] * parts)
            break
        room, least = room - r["words"], r["step"]
    got = steps.filter((F.col("step") >= least) | ((F.col("step") == least - 1) & (F.col("draw") < below))).select("word", "n").collect()
    return sorted((r["word"], r["n"]) for r in got)[:most] if counts else sorted(r["word"] for r in got)[:most]


def joined(df: DataFrame, counts: DataFrame, keys: list[str], k: str = "k", how: str = "inner", share: int = 1000) -> DataFrame:
    """``df`` with ``counts``, a row for each key with the number ``k`` of its rows in ``df``; ``how`` is inner or left. Keys that hold more than one row in ``share``, of which there are fewer than ``share``, are broadcast; their rows pass the join with the others under a salt of their whole numbers, so that they needn't meet in a task."""
    total, most = counts.agg(F.sum(k), F.max(k)).first()
    least = max(1000, (total or 0) // share)
    if (most or 0) <= least:
        return df.join(counts, keys, how)
    new = [c for c in counts.columns if c not in keys]
    hot = counts.filter(F.col(k) > least).select(*keys, *(F.col(c).alias(f"__{c}") for c in new))
    spread = [c for c, kind in df.dtypes if kind == "bigint" and c not in keys]
    marked = df.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col(f"__{k}").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(4095)) + 1))
    both = marked.join(counts.filter(F.col(k) <= least).withColumn("__salt", F.lit(0).cast("long")), [*keys, "__salt"], "left")
    out = both.select(*df.columns, *(F.coalesce(f"__{c}", c).alias(c) for c in new))
    return out.filter(F.col(k).isNotNull()) if how == "inner" else out


def bitmaps(ids: DataFrame, number: Column) -> DataFrame:
    """The numbers (0 or more) of ``ids`` as bitmaps of 32,768: (__part, __bits), bits in 512 longs, the first byte of each its highest."""
    part, place = F.shiftright(number, 15), number.bitwiseAND(32767)
    maps = ids.select(part.alias("__part"), place.alias("__place")).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    longs = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(__bits, 8 * i + 1, 8)), 16, -10) as bigint))")
    return maps.select("__part", longs.alias("__bits"))


def marked(df: DataFrame, maps: DataFrame, number: Column, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``number`` is in ``maps`` (see ``bitmaps``), which are broadcast, or with ``inside`` false the others."""
    place = number.bitwiseAND(32767)
    bit = F.getbit(F.get("__bits", F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).bitwiseXOR(56).cast("int"))
    both = df.withColumn("__part", F.shiftright(number, 15)).join(F.broadcast(maps), "__part", "inner" if inside else "left")
    return both.filter(bit == 1 if inside else F.coalesce(bit, F.lit(0)) == 0).select(*df.columns)


def among(df: DataFrame, ids: DataFrame, number: Column, most: int = 4096) -> DataFrame:
    """The rows of ``df`` whose ``number`` (0 or more) is that of a row of ``ids``, by bitmaps of 32,768 numbers (4 KB each) that are broadcast; all rows, where that takes more than ``most`` bitmaps. To go before a join, so that it shuffles less."""
    maps = staged(bitmaps(ids, number), "bitmaps")
    return df if maps.count() > most else marked(df, maps, number)


def without(df: DataFrame, ids: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """The rows of ``df`` whose ``key``, a number of 0 or more, no row of ``ids`` has: by bitmaps as in ``among``, or by a join where that takes more than ``most`` of them."""
    maps = staged(bitmaps(ids, F.col(key)), "bitmaps")
    return df.join(ids.select(key), key, "left_anti") if maps.count() > most else marked(df, maps, F.col(key), False)


def released() -> None:
    """Give the memory that a task has freed back to the system. A worker stays for later tasks, and what its allocators keep counts to its executor all the while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches (arrays, or tuples of them) in slices of few rows, so that what a task makes of long texts at once stays small."""
    for batch in batches:
        for start in range(0, len(batch[0] if isinstance(batch, tuple) else batch), rows):
            yield tuple(a.slice(start, rows) for a in batch) if isinstance(batch, tuple) else batch.slice(start, rows)
