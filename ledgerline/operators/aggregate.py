"""Aggregates over schemaless fields, and store figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Field


def aggregate_column(kind: str, number: Column | None) -> Column:
    """count; sum (what's no number counts as 0); avg over ALL rows; min and max, 0 without rows and infinite without numbers."""
    n = F.count("*")
    if kind == "count" or number is None:
        return n.cast("double")
    total = F.coalesce(F.sum(number), F.lit(0.0))
    if kind == "sum":
        return total
    if kind == "avg":
        return F.when(n == 0, 0.0).otherwise(total / n)
    if kind not in ("min", "max"):
        raise ValueError(f"unknown aggregate {kind!r}")
    best, none = (F.min(number), float("inf")) if kind == "min" else (F.max(number), float("-inf"))
    return F.when(n == 0, 0.0).otherwise(F.coalesce(best, F.lit(none)))


def aggregated(df: DataFrame, kind: str, field: str | None = None, data: str = "data") -> DataFrame:
    number = Field(data, field.removeprefix("data.")).number if field else None
    return df.agg(aggregate_column(kind, number).alias("value"))


def store_stats(docs: DataFrame) -> DataFrame:
    """(documents, collections, bytes, last_updated); no documents give 0, 0, 0 and null."""
    size = F.octet_length(F.to_json(F.struct(*docs.columns)))
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("collection").alias("collections"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max("updated_at").alias("last_updated"))


def collections(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection").agg(F.count("*").alias("documents"))


def histogram(df: DataFrame, value: str, bounds=(10, 50, 100, 500, 1000, 5000)) -> DataFrame:
    """(le, n): how many values each bound covers, and +Inf."""
    counts = df.agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("x")).select("x.*")


def rates(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", bytes_each: int = 200) -> DataFrame:
    """(keys, events, seconds, per_second, bytes_per_second, mean): events by the time they span, bytes estimated at ``bytes_each`` an event; no time gives rates of 0."""
    seconds = (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6
    out = df.groupBy(*keys).agg(F.count("*").alias("events"), seconds.alias("seconds"), F.avg(value).alias("mean"))
    per = F.when(F.col("seconds") > 0, F.col("events") / F.col("seconds")).otherwise(0.0)
    return out.select(*keys, "events", "seconds", per.alias("per_second"), (per * bytes_each).alias("bytes_per_second"), "mean")


def json_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON object for each (name, labels, value)."""
    return metrics.select(F.to_json(F.struct("name", "labels", "value")).alias("line"))


def prometheus(metrics: DataFrame, prefix: str = "ledger") -> DataFrame:
    """One text line for each (name, labels, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit('="'), F.regexp_replace(e.value, '(["\\\\])', "\\\\$1"), F.lit('"'))), ",")
    return metrics.select(F.concat(F.lit(prefix + "_"), "name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("line"))


def partition_stats(df: DataFrame, tenant: str, partition: Column) -> DataFrame:
    return df.groupBy(partition.alias("partition")).agg(F.countDistinct(tenant).alias("tenants"), F.count("*").alias("events"))
