import datetime as dt
import random
import time

import pytest

from tests.test_operators import T0, log
from tests.test_streaming_state import entries
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.query import SORT_FIELDS, HistoryQuery
from tidemark.streaming.dispatch import Dispatcher, enqueue
from tidemark.streaming.metrics import DispatchMetrics


def test_buckets_add_up(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1, 0, 1, 2, 5, 6, 10**6)], "v long")
    got = {r.bucket: (r.upper, r["count"], r.total) for r in metrics.histogram(df, F.col("v"), (0, 1, 5)).collect()}
    assert got == {0: (0.0, 2, -1), 1: (1.0, 1, 1), 2: (5.0, 2, 7), 3: (None, 2, 10**6 + 6)}
    row = df.agg(*metrics.observed("h", F.col("v"), (0, 1, 5))).first()
    assert tuple(row) == (2, 1, 2, 2)


def test_rows_behind_a_snapshot(spark):
    rows = log(spark, *[(f"{e}{k}", e, 1, k, {"snapshot": "{}" if (e, k) in (("a", 3), ("b", 9)) else None}) for e in "abc" for k in range(10)], ("d0", "d", 2, 0, {"snapshot": "{}"}))
    got = {r.upper: r["count"] for r in metrics.replayed_past_snapshot(rows, T0 + dt.timedelta(hours=8)).collect()}
    assert got == {5.0: 1, 10.0: 2, 1.0: 1}  # a: 4 to 8; b (its snapshot comes later) and c: all nine; a deletion's snapshot is no start


def test_listener_sums_batches(spark, tmp_path):
    heard = DispatchMetrics()
    spark.streams.addListener(heard)
    try:
        source = f"file://{tmp_path}/q"
        for k in range(3):
            enqueue(entries(spark, *[(f"{k}{n}", "a", 1, n, {"attempts": n % 2, "after_json": '{"x":"' + "y" * 300 * n + '"}'}) for n in range(4)]).coalesce(1), source, f"n{k}")
        Dispatcher(spark, source, f"file://{tmp_path}/out", max_files=1).flush()
        for _ in range(100):
            if heard.sums["batches"] == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert heard.sums["batches"] == 3 and heard.sums["entries"] == 12 and heard.sums["late"] == 12
    assert heard.histogram("attempts_bucket") == [6, 6, 0, 0, 0, 0]
    assert sum(heard.histogram("size_bucket")) == 12 and heard.histogram("size_bucket")[0] == 3
    assert heard.histogram("lag_bucket")[-1] == 12 and heard.most["max_lag_seconds"] > 3600


@pytest.mark.parametrize("newest_first", [True, False])
def test_pages_by_key_equal_one_order(spark, newest_first):
    pick = random.Random(7)
    rows = log(spark, *[(f"{k:03d}", "e", pick.randint(0, 2), pick.randint(0, 4), {"user_id": pick.choice([None, "", "u", "v"]), "entity_type": pick.choice(["A", "B"])}) for k in range(60)]).cache()
    for field in SORT_FIELDS:
        query = HistoryQuery(sort_by=field, newest_first=newest_first, take=7, actions=(0, 1))
        want = [r.id for r in query.filtered(rows).orderBy(*query.order()).collect()]
        got, cursors = [], []
        for page, cursor in query.walk(rows):
            got += [r.id for r in page]
            cursors.append(cursor)
        assert got == want
        resumed = [r.id for page, _ in query.walk(rows, cursors[2]) for r in page]
        assert resumed == want[21:]
    assert list(HistoryQuery(entity_type="none").walk(rows)) == []
