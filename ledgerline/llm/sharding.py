"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def byte_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Cut the rows, ordered by key, into ``shards`` contiguous runs of nearly equal size.

    A row's size is the UTF-8 length of its text plus 1 (null text: 1), so that empty rows count too. The narrow
    rows (no text) are range-sorted once and written with their partition's number and place. A row's global
    offset is the sum of the totals of all earlier partitions (one row a partition, hence small enough to
    broadcast) and its running sum in its own. Row r goes to shard ``floor(offset(r) * shards / total)``: shards differ
    by less than one row's size. Null keys come first; repeated keys and rows are told apart by size, checksum and
    place of reading, so a key with a third of all rows is cut like any other run. An empty table gives an empty one.
    Further columns of ``df`` are ignored. Returns key, size, text_crc32, shard, slot (place in the shard, from 0)
    and offset."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("read", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), "size", "text_crc32", "read"]
    rows = staged(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "shard-rows",
    )

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    totals = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(everywhere).alias("all_bytes"),
        )
    )
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.select(
            "*",
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("own_bytes"),
            F.row_number().over(Window.partitionBy("part").orderBy("place")).alias("own_row"),
        )
        .join(F.broadcast(totals), "part")  # one row a partition
        .select(
            "key",
            "size",
            "text_crc32",
            (F.col("bytes_before") + F.col("own_bytes")).alias("offset"),
            (F.col("rows_before") + F.col("own_row") - 1).alias("row"),
            "all_bytes",
        )
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.expr(f"offset * {shards} div all_bytes"))).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(  # one row a shard
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "offset"
    )
