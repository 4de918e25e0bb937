"""Histograms of a log and of its work, as counts in buckets that add up over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INSERTED, STREAM, UPDATED, tenant
from .filters import instant

#: Upper bounds (included) of the buckets; what is larger goes to one more.
SIZE_BYTES = (64, 256, 1024, 4096, 16_384, 65_536, 262_144, 1_048_576)
LAG_SECONDS = (0.1, 0.5, 1.0, 5.0, 30.0, 60.0, 300.0, 3600.0)
ROWS = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)
ATTEMPTS = (0, 1, 2, 3, 4)


def bucket(value: Column, bounds: tuple) -> Column:
    """The number of a value's bucket, from 0; null for null."""
    return F.when(value.isNotNull(), sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0)))


def histogram(df: DataFrame, value: Column, bounds: tuple) -> DataFrame:
    """(bucket, upper, count, total) of buckets that have values; upper is null for the last one."""
    found = df.select(value.alias("v")).where("v is not null").groupBy(bucket(F.col("v"), bounds).alias("bucket")).agg(F.count("*").alias("count"), F.sum("v").alias("total"))
    return found.select("bucket", F.get(F.array(*[F.lit(float(b)) for b in bounds]), F.col("bucket")).alias("upper"), "count", "total")


def observed(name: str, value: Column, bounds: tuple) -> list[Column]:
    """Counts for ``observe``: name_0, name_1 and so on, one for each bucket."""
    at = bucket(value, bounds)
    return [F.count_if(at == k).alias(f"{name}_{k}") for k in range(len(bounds) + 1)]


def entry_sizes(df: DataFrame) -> DataFrame:
    """Bytes of diff and snapshot of each row."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("diff", "snapshot")), F.lit(0)).cast("long")
    return histogram(df, size, SIZE_BYTES)


def replayed_past_snapshot(df: DataFrame, as_of) -> DataFrame:
    """How many rows replay has to apply behind the freshest snapshot that it can use, of
    each stream with rows by then: all of them where there is none."""
    rows = df.where(F.col("occurred_on_utc") <= instant(as_of)).withColumn("tenant", tenant())
    usable = F.col("snapshot").isNotNull() & F.col("action").isin(INSERTED, UPDATED)
    at = F.struct("occurred_on_utc", "id")
    newest = rows.groupBy(*STREAM).agg(F.max(F.when(usable, at)).alias("_snap"))
    behind = rows.join(newest, list(STREAM)).groupBy(*STREAM).agg(F.count_if(F.col("_snap").isNull() | (at > F.col("_snap"))).alias("n"))
    return histogram(behind, F.col("n"), ROWS)


def batch_sizes(df: DataFrame) -> DataFrame:
    """Rows of each correlation: what was captured together."""
    return histogram(df.groupBy("correlation_id").agg(F.count("*").alias("n")), F.col("n"), ROWS)
