"""Order-dependent columns without a window over a whole key: a tenant or an id may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in the global order. Rows are sorted by ranges and written once; a range's rows come after all rows of earlier ranges (a total for each range, small enough to broadcast)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ranked")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    totals = totals.select("__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    # ids run without gaps in a partition as it was written
    out = rows.join(F.broadcast(totals), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__first"))
    return out.drop("__part", "__id", "__first", "__before")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "sequence_number") -> DataFrame:
    """A gapless number from 1 for each row of a key, in order."""
    rows = ranked(df, [*keys, *order], "__rank")
    # written, so that Spark knows how few keys there are and need not shuffle all rows for them
    first = staged(rows.groupBy(*keys).agg(F.min("__rank").alias("__least")), "first-ranks")
    return rows.join(first, keys).withColumn(name, F.col("__rank") - F.col("__least") + 1).drop("__rank", "__least")


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = 1 << 16, in_order: bool = False) -> DataFrame:
    """``df`` with the last value of its key that isn't null, before the row. ``order`` is a whole number and unique in its key.

    Windows go over blocks of ``order`` only; what a block hands on is its last value, one row a block. With ``in_order``, for an ``order`` without gaps,
    blocks are dealt by ranges, so that later partitions have later rows, and ``value`` is worked out behind the one shuffle of all rows."""
    own = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__block", F.expr(f"floor({order} / {block})"))
    named = rows.withColumn("__value", value)
    rows = (rows.repartitionByRange(*keys, "__block") if in_order else rows).withColumn("__value", value)
    handed = named.filter(F.col("__value").isNotNull()).groupBy(*keys, "__block").agg(F.max_by("__value", order).alias("__last"))
    blocks = named.select(*keys, "__block").distinct().join(handed, [*keys, "__block"], "left")
    past = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__block", F.last("__last", ignorenulls=True).over(past).alias("__handed"))
    rows = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(own))
    return rows.join(F.broadcast(blocks) if in_order else blocks, [*keys, "__block"]).withColumn(name, F.coalesce("__own", "__handed")).drop("__block", "__value", "__own", "__handed")


def at_ranks(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value) at place floor(n * share) of the sorted values, the last one at most; nulls are left out, and no rows give no rows."""
    rows = ranked(df.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()), ["value"])
    n = rows.agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    wanted = wanted.join(F.broadcast(n)).select("share", F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1).alias("rank"))
    return rows.join(F.broadcast(wanted), "rank").select("share", "value")
