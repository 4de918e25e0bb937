"""Running values over groups that lie in several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as cn
from tidemark.operators import integrity
from tidemark.plans import segments
from tidemark.sources.shared import stored


def _brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, most, before, lagged = 0, None, None, {}
        for _, at, value in sorted(r for r in rows if r[0] == key):
            total += value or 0
            most = value if most is None else most if value is None else max(most, value)
            lagged[at] = before
            out[key, at] = (total, most, before)
            before = value
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_equals_a_walk(spark, parts):
    pick = random.Random(parts)
    keys = ["hot"] * 30 + ["", None, "a", "b", "c"]
    rows = [(pick.choice(keys), k, pick.choice([None, *range(-5, 9)])) for k in range(600)]
    rows = [(k or "none", at, v) if k is None else (k, at, v) for k, at, v in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k string, at int, v int")
        df = df.withColumn("k", F.nullif("k", F.lit("none")))
        value = F.col("v")
        got = segments.running(df, ["k"], ["at"], sums={"s": F.coalesce(value, F.lit(0))}, maxes={"m": value}, lags={"l": value}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.k or "none" if r.k != "" else "", r.at): (r.s, r.m, r.l) for r in got} == _brute(rows) and len(got) == len(rows)
    assert segments.running(df.where("false"), ["k"], ["at"], sums={"s": F.lit(1)}).count() == 0


def _hot(spark, n):
    """A log of which one stream has nine rows in ten."""
    hot = F.col("n") % 10 != 0
    rows = spark.range(n).withColumnRenamed("id", "n")
    texts = {c: F.lit(None).cast("string") for c in ("entity_base_type", "user_id", "user_display", "user_type", "tenant_id", "correlation_id", "snapshot", "error", "entry_hash", "previous_hash")}
    made = rows.select(
        F.lpad(F.col("n").cast("string"), 9, "0").alias("id"), F.lit("T").alias("entity_type"), F.when(hot, "hot").otherwise(F.concat(F.lit("e"), F.col("n"))).alias("entity_id"), F.lit(1).alias("action"),
        F.timestamp_add("SECOND", F.col("n").cast("int"), F.lit("2024-01-01T00:00:00").cast("timestamp_ntz")).alias("occurred_on_utc"), F.lit("[]").alias("diff"),
        *[v.alias(k) for k, v in texts.items()], F.lit(None).cast("int").alias("hash_key_id"), F.lit(None).cast("long").alias("chain_sequence"),
    )
    return made


def test_a_hot_stream_is_verified_in_ranges(spark, monkeypatch):
    key = bytes(range(16))
    log = stored(integrity.stamp(_hot(spark, 4000), integrity.no_anchors(_hot(spark, 0)), 1, key))
    anchors = integrity.advanced_anchors(integrity.no_anchors(log), log)
    ranges = []
    plain = segments.stored
    monkeypatch.setattr(segments, "stored", lambda df: (lambda kept: (ranges.append([r["count"] for r in kept.groupBy(segments._SEG).count().collect()]), kept)[1])(plain(df)))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        checked = integrity.verify_chain(log, anchors, {1: key}).first()
        assert checked.is_valid and checked.verified == 4000
        assert max(ranges[-1]) < 4000 / 8 * 2 and len(ranges[-1]) == 8  # 3600 rows of one stream, in about 8 ranges
        broken = log.withColumn("user_id", F.when(F.col("id") == "000003001", "mallory"))
        found = integrity.verify_chain(broken, anchors, {1: key}).first()
        assert (found.is_valid, found.reason, found.break_id) == (False, "ContentMismatch", "000003001")
        without = log.where("id != '000002002'")  # the row behind a gap tells
        found = integrity.verify_chain(without, anchors, {1: key}).first()
        assert (found.reason, found.break_id) == ("BrokenLink", "000002003")
        due = log.where("id < '000003500' and id != '000003011'")
        kept = integrity.prunable(due, anchors)
        assert kept.where("entity_id = 'hot'").agg(F.max("id")).first()[0] == "000003009"
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rows_of_equal_ids_are_stamped_once_each(spark):
    rows = _hot(spark, 20).unionByName(_hot(spark, 20))
    out = integrity.stamp(rows, integrity.no_anchors(rows), 1, bytes(16))
    assert out.count() == 40 and out.select("entry_hash").distinct().count() == 40 and out.columns == rows.columns
    assert out.where(F.col("entry_hash") == cn.hmac_sha256(bytes(16), cn.canonical(F.col("previous_hash")))).count() == 40
