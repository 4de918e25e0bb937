from pyspark.sql import functions as F

from tidemark.functions import canonical as cn
from tidemark.operators import integrity
from tidemark.streaming.cadence import Every
from tidemark.streaming.dispatch import QUEUE, Dispatcher

KEY = bytes(range(16))


def _queue(spark, path, rows):
    names = [c.split()[0] for c in QUEUE.split(", ")]
    made = [(i, "T", None, e, 1, b, a, None, "u", None, None, None, "c", n, None, '{"region":"eu"}') for i, e, b, a, n in rows]
    assert len(made[0]) == len(names)
    spark.createDataFrame(made, QUEUE).withColumn("occurred_on_utc", F.expr("timestamp_ntz '2024-01-01 00:00:00'")).coalesce(1).write.mode("append").parquet(path)


def test_dispatch_chain_retry_and_dead_letters(spark, tmp_path):
    source, published = f"file://{tmp_path}/queue", []
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", publish=lambda events, n: published.extend(r.audit_log_id for r in events.collect()), custom_schema="region string", key=(1, KEY))
    _queue(spark, source, [("1", "a", "{}", '{"x":1}', 0), ("2", "a", '{"x":1}', '{"x":2}', 0), ("3", "b", "{", "{}", 0), ("4", "b", "{", "{}", 4)])
    run.flush()
    assert sorted(published) == ["1", "2"]
    assert {r.id: r.region for r in run.log().collect()} == {"1": "eu", "2": "eu"}
    assert [(r.id, r.attempts) for r in run.dead().collect()] == [("4", 5)]
    _queue(spark, source, [("5", "a", '{"x":2}', '{"x":3}', 0)])
    run.flush()
    log = run.log()
    assert sorted((r.id, r.chain_sequence) for r in log.collect()) == [("1", 1), ("2", 2), ("5", 3)]
    checked = integrity.verify_chain(log, run.anchors(1), {1: KEY}, custom=cn.custom_texts(log, ["region"])).first()
    assert checked.is_valid and checked.verified == 3
    run.flush()  # nothing new: nothing happens
    assert run.log().count() == 3


def test_each_failure_is_redelivered_once(spark, tmp_path):
    """An entry that fails in the second batch and again: one copy of it at any time."""
    source, told = f"file://{tmp_path}/queue", []
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", observers=[lambda batch, written, failed: told.append((batch, written, failed))])
    _queue(spark, source, [("1", "a", "{}", '{"x":1}', 0)])
    run.flush()
    _queue(spark, source, [("2", "a", "{", "{}", 2), ("3", "b", "{}", "{}", 0)])
    run.flush()
    assert run.redeliver() == 1 and run.redeliver() == 0
    run.flush()
    assert run.redeliver() == 1
    run.flush()
    assert run.redeliver() == 0
    assert [(r.id, r.attempts) for r in run.dead().collect()] == [("2", 5)]
    assert sorted(r.id for r in run.log().collect()) == ["1", "3"]
    assert told == [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, 0, 1)]


def test_snapshots_and_bad_custom_columns(spark, tmp_path):
    source = f"file://{tmp_path}/queue"
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", custom_schema="size int, region string", policy=Every(2))
    _queue(spark, source, [(str(k), "a", f'{{"x":{k}}}', f'{{"x":{k + 1}}}', 0) for k in range(3)])
    run.flush()
    rows = spark.read.schema(QUEUE).parquet(source)
    more = rows.where("id in ('0', '1')").withColumn("id", F.concat(F.lit("n"), "id")).withColumn("action", F.when(F.col("id") == "n0", 2).otherwise(1))
    more.withColumn("custom_columns_json", F.when(F.col("id") == "n0", '{"size":"big"}').otherwise('{"size":{"a":1}}')).coalesce(1).write.parquet(f"{tmp_path}/more")
    spark.read.parquet(f"{tmp_path}/more").coalesce(1).write.mode("append").parquet(source)
    run.flush()
    got = {r.id: (r.snapshot, r.error, r.size, r.region) for r in run.log().collect()}
    assert got["0"] == (None, None, None, "eu") and got["1"][0] == '{"x":2}' and got["2"][0] is None
    assert got["n0"] == ('{"x":0}', "AddColumn 'size': dispatch deserialize failed", None, None)
    assert got["n1"] == ('{"x":2}', None, None, None)
