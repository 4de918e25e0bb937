import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding as s
from tidemark.llm.common import scratch


def _rows(spark, n, start=0):
    ids = spark.range(start, start + n, 1, 3)
    return ids.select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.repeat(F.lit("ab é "), (F.col("id") % 90 + 1).cast("int"))).alias("text"), F.lit("x").alias("shard"), F.lit(1).alias("run"), F.lit(2).alias("bytes"))


def _key(df):
    return sorted(map(str, df.collect()))


def test_append_compact_and_read(spark):
    store = s.ShardStore(spark, scratch(spark), small_bytes=4000, target_bytes=60_000)
    first, second = _rows(spark, 900), _rows(spark, 300, 5000).unionByName(_rows(spark, 3)).unionByName(_rows(spark, 3))
    store.append(first)
    store.append(second, arrival=F.col("doc_id") % 3)
    assert store.version() == 2 and _key(store.read()) == _key(first.unionByName(second))
    shards = store.manifest().collect()
    assert max(r.bytes for r in shards) < 30_000
    assert store.compact() == 3
    while store.compact():
        pass
    assert _key(store.read()) == _key(first.unionByName(second)) and _key(store.read(1)) == _key(first)
    after = store.manifest().collect()
    assert len(after) < len(shards) / 2 and max(r.bytes for r in after) <= 70_000
    assert sum(r.rows for r in after) == 1206 and sum(r.bytes for r in after) == sum(r.bytes for r in shards)
    assert store.vacuum() >= 2 and _key(store.read()) == _key(first.unionByName(second))
    assert store.read(with_shard="of").columns[-1] == "of"


def test_only_one_writer_commits_a_version(spark):
    store = s.ShardStore(spark, scratch(spark))
    store.append(_rows(spark, 20))
    with pytest.raises(s.Conflict):
        store._commit(store.manifest(), 1)
    assert store.version() == 1 and store.read().count() == 20


def test_empty(spark):
    store = s.ShardStore(spark, scratch(spark))
    assert store.manifest().count() == 0
    store.append(_rows(spark, 0))
    assert store.read().count() == 0 and store.compact() is None
    store.append(_rows(spark, 5))
    assert store.read().count() == 5


def test_writers_at_the_same_time_lose_no_files(spark):
    """Two arrivals are written together: one commits the version, the other one again afterwards."""
    from concurrent.futures import ThreadPoolExecutor

    store = s.ShardStore(spark, scratch(spark), small_bytes=4000)
    store.append(_rows(spark, 10))

    def add(k):
        for _ in range(9):
            try:
                return s.ShardStore(spark, store.at, small_bytes=4000).append(_rows(spark, 200, 1000 * k))
            except s.Conflict:
                continue

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(add, (1, 2, 3))) == [2, 3, 4]
    assert _key(store.read()) == _key(_rows(spark, 10).unionByName(_rows(spark, 200, 1000)).unionByName(_rows(spark, 200, 2000)).unionByName(_rows(spark, 200, 3000)))


def test_query_with_clashing_columns_and_long_texts(spark, tmp_path):
    rows = [(1, "short"), (1, "short"), (2, None), (None, ""), (3, "long " * 400_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own")).withColumn("run", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op4_sharding(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == [("1", 5), ("1", 5), ("2", 0), ("3", 2_000_000), ("None", 0)]
    assert all("/" in r.shard for r in got)


def test_vacuum_leaves_a_writer_at_work_alone(spark, monkeypatch):
    store = s.ShardStore(spark, scratch(spark), small_bytes=4000)
    store.append(_rows(spark, 50))
    write, gone = store._write, []

    def written(rows, run):
        write(rows, run)
        gone.append(store.vacuum())  # between a writer's data and its commit

    monkeypatch.setattr(store, "_write", written)
    store.append(_rows(spark, 10, 900))
    assert gone == [0] and store.read().count() == 60


def test_query_of_an_empty_table(spark, tmp_path):
    _rows(spark, 0).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert s.op4_sharding(spark, f"file://{tmp_path}").collect() == []
