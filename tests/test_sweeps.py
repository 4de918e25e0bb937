"""Sweeps that stop at a deadline, resume, and keep to a budget."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import KEY, T0, log
from tidemark.operators import compaction, integrity, retention
from tidemark.operators.sweeps import CompactionSweep, RetentionSweep, archive_to
from tidemark.schema import HistoryError

HOUR = dt.timedelta(hours=1)


class Clock:
    """Runs on by a second with each reading."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        self.now += 1
        return self.now


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_retention_stops_and_resumes(spark, tmp_path):
    rows = log(spark, *[(f"{k:03d}", f"e{k % 7}", 1, k) for k in range(60)])
    now, policy = T0 + 60 * HOUR, retention.RetainFor(20 * HOUR)
    make = lambda at, **more: RetentionSweep(spark, f"file://{tmp_path}/{at}", policy, slices=4, archivers=(archive_to(f"file://{tmp_path}/archive"),), clock=Clock(), **more)
    first = make("a").run(rows, now, dt.timedelta(seconds=2))
    assert first.done == 1 and not first.finished
    left = _ids(make("a").log(rows))
    assert left == [f"{k:03d}" for k in range(60 - len(left), 60)] and len(left) == 60 - first.taken  # the oldest went first
    assert make("a").run(rows, now, dt.timedelta(0)).taken == 0
    more = rows.unionByName(log(spark, ("new", "e1", 1, 0)))  # what came meanwhile isn't decided upon
    second = make("a").run(more, now)  # a new process: progress is in the folder
    assert second.finished and first.taken + second.taken == 40
    assert _ids(make("a").log(more)) == sorted(["new", *(f"{k:03d}" for k in range(40, 60))])
    assert _ids(spark.read.parquet(f"{tmp_path}/archive")) == [f"{k:03d}" for k in range(40)]
    assert make("a").run(rows, now).taken == 0


def test_a_slice_cut_short_is_archived_once(spark, tmp_path):
    rows = log(spark, *[(f"{k:03d}", "e", 1, k) for k in range(20)])
    fail = [True]

    def flaky(part, k):
        if fail[0] and k == 1:
            raise ConnectionError("cut")

    sweep = RetentionSweep(spark, f"file://{tmp_path}/s", retention.RetainFor(HOUR), slices=2, archivers=(archive_to(f"file://{tmp_path}/archive"), flaky))
    with pytest.raises(ConnectionError):
        sweep.run(rows, T0 + 40 * HOUR)
    assert sweep.log(rows).count() == 20 - sweep.removed().count() > 0  # its rows stay, though archived
    fail[0] = False
    assert sweep.run(rows, T0 + 40 * HOUR).finished and sweep.log(rows).count() == 0
    assert _ids(spark.read.parquet(f"{tmp_path}/archive")) == _ids(rows)


def test_chains_stay_whole_at_every_stop(spark, tmp_path):
    rows = log(spark, *[(f"{k:03d}", f"e{k % 5}", 1, k) for k in range(40)])
    chained = integrity.stamp(rows, integrity.no_anchors(rows), 1, KEY).cache()
    anchors = integrity.advanced_anchors(integrity.no_anchors(rows), chained).cache()
    policy, now = retention.RetainFor(10 * HOUR), T0 + 40 * HOUR
    sweep = RetentionSweep(spark, f"file://{tmp_path}/s", policy, slices=3, clock=Clock())
    with pytest.raises(HistoryError):
        RetentionSweep(spark, f"file://{tmp_path}/without", policy).run(chained, now)
    with pytest.raises(HistoryError):
        retention.sweep(chained, policy, now, f"file://{tmp_path}/out")
    while True:
        progress = sweep.run(chained, now, dt.timedelta(seconds=2), anchors)
        checked = integrity.verify_chain(sweep.log(chained), integrity.valid_anchors(sweep.anchors(anchors)), {1: KEY}).first()
        assert checked.is_valid, checked
        if progress.finished:
            break
    assert sweep.log(chained).count() == 10


def test_compaction_in_slices_equals_one_sweep(spark, tmp_path):
    pick = random.Random(2)
    rows = log(spark, *[(f"{k:03d}", f"e{min(pick.randint(0, 9), pick.randint(0, 9))}", 0 if k < 1 else 1, k, {"diff": f'[{{"op":"add","path":"/v","value":{k}}}]'}) for k in range(90)])
    sweep, calls = CompactionSweep(spark, f"file://{tmp_path}/c", 6, 2, None, slices=3, clock=Clock()), []
    while not calls or not calls[-1].finished:
        calls.append(sweep.run(rows, dt.timedelta(seconds=2)))
        assert sweep.log(rows).count() == 90 - sum(c.taken for c in calls)
    assert len(calls) > 1
    whole = compaction.sweep(rows, f"file://{tmp_path}/whole", 6, 2, None)
    assert whole == sum(c.taken for c in calls)
    key = lambda df: sorted((r.id, r.action, r.diff, r.snapshot) for r in df.collect())
    assert key(sweep.log(rows)) == key(spark.read.parquet(f"{tmp_path}/whole"))


def test_count_budget_equals_a_loop_over_groups(spark):
    pick = random.Random(4)
    made = [(f"{k:03d}", pick.choice(["hot", "hot", "hot", "a", "b"]), 1, pick.randint(0, 30), {"tenant_id": pick.choice([None, "", "t"])}) for k in range(200)]
    rows = log(spark, *made).repartition(7)
    groups = {}
    for id_, entity, _, hours, more in made:
        groups.setdefault((entity, more["tenant_id"] is not None, more["tenant_id"] or ""), []).append((hours, id_))
    for keep, budget in ((3, 1), (5, 60), (2, 120), (0, 10_000)):
        want = []
        for key in sorted(groups):
            want += [i for _, i in sorted(groups[key], reverse=True)[keep:][: max(0, budget - len(want))]]
        assert _ids(retention.expired(rows, retention.RetainCount(keep), T0, budget)) == sorted(want)
