"""Grouped counts, calendar rollups and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import action_name, iso, tenant

BUCKETS = ("hour", "day", "month")


def by_column(df: DataFrame, name: str) -> DataFrame:
    """(key, count); a missing value is a group of its own, and so is ''."""
    key = action_name() if name == "action" else F.col(name)
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("count"))


def by_time(df: DataFrame, bucket: str) -> DataFrame:
    """(bucket_start_utc, key, count); empty buckets are absent."""
    if bucket not in BUCKETS:
        raise ValueError(f"no such bucket: {bucket}")
    start = F.date_trunc(bucket, "occurred_on_utc").cast("timestamp_ntz")
    return df.groupBy(start.alias("bucket_start_utc")).agg(F.count("*").alias("count")).select("bucket_start_utc", iso("bucket_start_utc").alias("key"), "count")


def rollup_by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("occurred_on_utc").alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def rollup_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("occurred_on_utc").alias("year"), F.month("occurred_on_utc").alias("month")).agg(F.count("*").alias("count")).orderBy("year", "month")


def rollup_by_day_and_action(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("occurred_on_utc").alias("day"), "action").agg(F.count("*").alias("count")).orderBy("day", "action")


def _top(n: int) -> int:
    if n < 1:
        raise ValueError("a top list has at least one place")
    return n


def rollup_by_day_and_user(df: DataFrame, top: int) -> DataFrame:
    """Each day's ``top`` users; equal counts go by user. Counted before the days are ranked."""
    counts = df.where("user_id is not null").groupBy(F.to_date("occurred_on_utc").alias("day"), "user_id").agg(F.count("*").alias("activity_count"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("activity_count"), "user_id"))
    return counts.withColumn("place", place).where(F.col("place") <= _top(top)).drop("place").orderBy("day", F.desc("activity_count"), "user_id")


def top_actors(df: DataFrame, top: int) -> DataFrame:
    counts = df.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("activity_count"))
    return counts.orderBy(F.desc("activity_count"), "user_id").limit(_top(top))


def distinct_users(df: DataFrame) -> DataFrame:
    return df.where("user_id is not null").select("user_id").distinct()


def stream_sizes(df: DataFrame) -> DataFrame:
    """Rows of each stream, and whether any of them is chained."""
    return df.groupBy("entity_type", "entity_id", tenant().alias("tenant")).agg(F.count("*").alias("total"), F.bool_or(F.col("entry_hash").isNotNull()).alias("chained"))


def queue_depth(queue: DataFrame) -> DataFrame:
    """One row: entries that wait, and entries that were given up."""
    return queue.agg(F.count_if(F.col("error").isNull()).alias("waiting"), F.count_if(F.col("error").isNotNull()).alias("dead"))


def all_streams(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Streams that have rows or an anchor."""
    keys = ["entity_type", "entity_id", "tenant"]
    return df.select("entity_type", "entity_id", tenant().alias("tenant")).unionByName(anchors.select(*keys)).distinct()


def oversized(df: DataFrame, rows: int) -> DataFrame:
    """Groups of (type, entity, tenant) with more rows than that; null and '' are two tenants."""
    return df.groupBy("entity_type", "entity_id", "tenant_id").agg(F.count("*").alias("total")).where(F.col("total") > rows)


def batch_summary(df: DataFrame) -> DataFrame:
    """Per stream of a batch: its last row's id and hash (null if it isn't chained), and how many rows came."""
    return df.groupBy("entity_type", "entity_id", tenant().alias("tenant")).agg(F.max_by("id", F.struct("occurred_on_utc", "id")).alias("last_id"), F.max_by("entry_hash", F.coalesce("chain_sequence", F.lit(0))).alias("last_hash"), F.count("*").alias("added"))
