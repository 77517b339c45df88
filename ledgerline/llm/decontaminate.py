"""Benchmark decontamination with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .common import lower_ascii

#: The fixed classes of the contract, for Java's regular expressions, after A-Z have become small.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


#: The same before that.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: str | Column) -> Column:
    """Normalised words of a text; none for null."""
    return F.coalesce(F.filter(F.split(lower_ascii(text), GAP + "+"), lambda w: w != ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """Distinct windows of all items: ``window`` (words joined by a blank), ``width`` in words, ``hash``, and the sorted ids of the items they are in. An item of fewer than n words, but not none, is one window."""
    w = items.select(F.col(item).cast("string").alias("item"), words_of(text).alias("words")).filter(F.size("words") > 0)
    w = w.withColumn("width", F.least(F.size("words"), F.lit(n)))
    w = w.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.slice("words", i, F.col("width")))).alias("words"))
    return w.groupBy(F.array_join("words", " ").alias("window"), "width", F.xxhash64("words").alias("hash")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _candidates(words: Column, widths: list[int]) -> Column:
    """All windows of a document as (place, width, hash)."""

    def of(width: int) -> Column:
        ends = F.size(words) - width
        places = F.when(ends >= 0, F.sequence(F.lit(1), ends + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(width).alias("width"), F.xxhash64(F.slice(words, i, width)).alias("hash")))

    return F.concat(*(of(w) for w in widths)) if widths else F.array().cast("array<struct<place:int,width:int,hash:bigint>>")


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, most_windows: int = 50_000, most_bytes: int = 8_000_000) -> DataFrame:
    """``docs`` with ``words`` (normalised) and ``hits``: (place, width, window) of every window of an item that occurs.

    Up to ``most_windows`` distinct windows of ``most_bytes`` in all, the hash set of windows is part of the
    expression that each task evaluates, and documents are scanned once and never shuffled: windows whose 64-bit hash is in the set are
    verified against the windows' words. A larger benchmark is joined by hash instead, and what matches is
    verified by words. Null and empty texts have no words and no hits; an empty benchmark hits nothing. Columns of ``docs`` that are
    named ``words`` or ``hits`` give way to these; others pass through, whatever their names."""
    found = _with_hits(docs, items, text, item, item_text, n, most_windows, most_bytes)
    return found.select(*(_own(c).alias(c) for c in docs.columns if c.lower() not in ("words", "hits")), "words", "hits")


def _own(column: str) -> Column:
    """A column of the documents, in what ``_with_hits`` gives."""
    return F.col(f"doc.`{column}`")


def _with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, most_windows: int = 50_000, most_bytes: int = 8_000_000) -> DataFrame:
    """``doc``, a struct of the documents' columns, whose names so meet no others; ``words`` and ``hits``."""
    windows = item_windows(items, item, item_text, n)
    size = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("window")).alias("bytes"), F.collect_set("width").alias("widths")).first()
    widths = sorted(size["widths"])  # n at most
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("words", words_of(_own(text)))
    if size["n"] > most_windows or (size["bytes"] or 0) > most_bytes:
        return _joined_hits(docs, windows, widths)
    known = windows.select("hash", "window").collect()
    if not known:
        return docs.withColumn("hits", F.expr("cast(array() as array<struct<place:int,width:int,window:string>>)"))
    hashes = ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in sorted({r["hash"] for r in known}))
    docs = docs.withColumn("found", F.filter(_candidates(F.col("words"), widths), lambda x: F.lit(True)))
    docs = docs.withColumn("found", F.expr(f"filter(found, x -> x.hash in ({hashes}))"))
    docs = docs.withColumn("hits", F.transform("found", lambda x: F.struct(x.place.alias("place"), x.width.alias("width"), F.array_join(F.slice("words", x.place, x.width), " ").alias("window"))))
    return docs.withColumn("hits", F.expr(f"filter(hits, x -> x.window in ({_quoted(sorted({r['window'] for r in known}))}))")).drop("found")


def _joined_hits(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    rows = staged(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    found = (
        rows.select("row", F.explode(_candidates(F.col("words"), widths)).alias("x"))
        .select("row", "x.place", "x.width", F.col("x.hash").alias("hash"))
        .join(windows.select("hash", "width").distinct(), ["hash", "width"], "left_semi")
        .groupBy("row")
        .agg(F.collect_list(F.struct("place", "width")).alias("found"))
    )
    seen = rows.join(found, "row").select("row", F.explode(F.transform("found", lambda x: F.struct(x.place.alias("place"), x.width.alias("width"), F.array_join(F.slice("words", x.place, x.width), " ").alias("window")))).alias("hit"))
    seen = seen.join(windows.select(F.col("window").alias("w")), F.col("hit.window") == F.col("w"), "left_semi")
    hits = seen.groupBy("row").agg(F.collect_list("hit").alias("hits"))
    none = F.expr("cast(array() as array<struct<place:int,width:int,window:string>>)")
    return rows.join(hits, "row", "left").withColumn("hits", F.coalesce("hits", none)).drop("row")


def hit_words(hits: str = "hits") -> Column:
    """Distinct places (from 1) of the words that lie in a hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x.place, x.place + x.width - 1))))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, **limits) -> DataFrame:
    """One row a document: key, n_words, n_hit, n_items, items_sha256, contaminated. Repeated documents give repeated rows."""
    windows = item_windows(items, item, item_text, n).select("window", "items")
    found = _with_hits(docs.select(key, text), items, text, item, item_text, n, **limits)
    found = found.select(_own(key).alias("key"), F.size("words").cast("long").alias("n_words"), F.size(hit_words()).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x.window)).alias("seen"))
    found = found.withColumn("row", F.monotonically_increasing_id())  # before explode, so that a document's windows share it
    found = found.withColumn("window", F.explode_outer("seen")).drop("seen")
    # what AQE finds small enough is broadcast, else both sides are shuffled
    found = found.join(windows, "window", "left").groupBy("row", "key", "n_words", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_documents(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents in which no window of an item occurs; columns as they came, whatever their names."""
    # a filter isn't pushed below a row number, where it would find the words again for each window
    found = _with_hits(docs, items, text, **kw).withColumn("row", F.monotonically_increasing_id())
    return found.filter((F.size("hits") == 0) & (F.col("row") >= 0)).select("doc.*")


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """All documents, each hit word cut from the text together with the gap before it; columns as they came, whatever their names."""
    found = _with_hits(docs, items, text, **kw).withColumn("hit", hit_words())
    pieces = F.regexp_extract_all(_own(text), F.lit(f"{RAW_GAP}*{RAW_WORD}+"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("hit", i + 1)), "")
    tail = F.regexp_extract(_own(text), RAW_GAP + r"*\z", 0)
    cleaned = F.when(F.size("hits") > 0, F.concat(kept, tail)).otherwise(_own(text))
    return found.select(*((cleaned if c == text else _own(c)).alias(c) for c in docs.columns))
