"""State, anchors and events over several batches, restarts and replays."""

import datetime as dt
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import canonical as cn
from tidemark.functions import jsonpatch as jp
from tidemark.operators import importer, integrity
from tidemark.sources.shared import Files
from tidemark.streaming.anchors import AnchorLog
from tidemark.streaming.cadence import Every, EveryDuration, _Cursor, started
from tidemark.streaming.dispatch import QUEUE, Dispatcher, enqueue
from tidemark.streaming.outbox import Outbox

T0 = dt.datetime(2024, 1, 1)
KEY = bytes(range(16))


def entries(spark, *rows):
    """(id, entity, action, minutes) with images of the minute, and other columns by name."""
    names = [c.split()[0] for c in QUEUE.split(", ")]
    made = []
    for id_, entity, action, minutes, *more in rows:
        base = dict.fromkeys(names) | {"id": id_, "entity_type": "T", "entity_id": entity, "action": action, "occurred_on_utc": T0 + dt.timedelta(minutes=minutes), "attempts": 0, "before_json": f'{{"m":{minutes - 1}}}', "after_json": f'{{"m":{minutes}}}'}
        made.append(tuple((base | (more[0] if more else {}))[c] for c in names))
    return spark.createDataFrame(made, QUEUE)


def test_cadence_counts_over_batches_and_restarts(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for policy, want in ((Every(3), {"2", "5", "8"}), (EveryDuration(dt.timedelta(minutes=25)), {"0", "3", "6", "9"})):
        source = f"file://{tmp_path}/{type(policy).__name__}"
        run = lambda p=policy, s=source: Dispatcher(spark, s, f"{out}/{type(p).__name__}", policy=p)
        for k in range(10):
            more = [(f"i{k}", "a", 0, 10 * k + 1), (f"d{k}", "b", 2, 10 * k), (f"bad{k}", "a", 1, 10 * k + 2, {"before_json": "{"})] if k % 4 == 0 else []
            enqueue(entries(spark, (str(k), "a", 1, 10 * k), *more), source, f"n{k}")
            if k % 3 == 2:
                run().flush()  # a new dispatcher each time: its state comes from the checkpoint
        run().flush()
        log = run().log()
        assert {r.id for r in log.where("entity_id = 'a' and snapshot is not null").collect()} == want
        assert {r.snapshot for r in log.where("id = '8' and snapshot is not null").collect()} <= {'{"m":80}'}
        assert log.where("entity_id = 'b' and snapshot is null").count() == 0  # a deletion keeps its state, whatever the policy
    for bad in (lambda: Every(0), lambda: EveryDuration(dt.timedelta(0))):
        with pytest.raises(ValueError):
            bad()


def _anchor(entity, n):
    return ("T", entity, "", f"hash{n}", n, 1, 0, None)


def test_anchor_log_writes_what_changed_and_merges(spark, tmp_path):
    log = AnchorLog(spark, f"file://{tmp_path}/anchors", fan=3)
    files, sizes, newest = Files(spark, log.at), [], {}
    for n in range(14):
        changed = [_anchor(f"e{k}", n + 1) for k in (range(500) if n == 0 else [n % 5])]
        newest |= {a[1]: a[4] for a in changed}
        made = log.fold(n - 1)
        assert all(hi < n for _, hi in made)  # this batch may be replayed
        for _ in range(2):  # and is, here
            log.append(spark.createDataFrame(changed, integrity.ANCHOR).coalesce(1), n)
        sizes.append(files.size(log._name((n, n))))
        assert {r.entity_id: r.row_count for r in log.read(n).collect()} == newest
        assert log.read(n - 1).count() == (500 if n else 0)
    assert max(sizes[1:]) - min(sizes[1:]) < 100 and sizes[0] > 1.5 * max(sizes[1:])  # not by the number of streams
    assert len(log.runs(13)) <= 6 and log.runs(13)[0] == (0, 8)
    asked = spark.createDataFrame([("T", "e3", "")], "entity_type string, entity_id string, tenant string")
    assert [r.row_count for r in log.read(13, asked).collect()] == [14]
    assert log.read(3).where("entity_id = 'e3'").count() <= 1


def test_chain_over_batches_covers_custom_columns(spark, tmp_path):
    source, out = f"file://{tmp_path}/q", f"file://{tmp_path}/out"
    run = Dispatcher(spark, source, out, custom_schema="region string, size int", key=(1, KEY), max_files=1)
    for k in range(6):
        enqueue(entries(spark, (f"{k}", "a", 1, k, {"custom_columns_json": '{"region":"eu","size":3}'}), (f"o{k}", f"o{k}", 0, k)).coalesce(1), source, f"n{k}")
        run.flush()
    log, names = run.log(), ["region", "size"]
    checked = lambda df: integrity.verify_chain(df, run.anchors(5), {1: KEY}, custom=cn.custom_texts(df, names)).first()
    assert checked(log).is_valid and checked(log).verified == 12
    found = checked(log.withColumn("size", F.when(F.col("id") == "3", 4).otherwise(F.col("size"))))
    assert (found.reason, found.break_id) == ("ContentMismatch", "3")
    assert spark.read.parquet(f"{out}/log/batch=4").count() == 2 and run.anchor_log.runs(5)[-1] == (5, 5)


def test_observers_that_fail_cost_nothing(spark, tmp_path):
    told = []

    def bad(batch, written, failed):
        raise RuntimeError("observer")

    run = Dispatcher(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/out", observers=[bad, lambda *x: told.append(x)])
    enqueue(entries(spark, ("1", "a", 0, 0)), f"file://{tmp_path}/q", "n")
    run.flush()
    assert run.log().count() == 1 and told == [(0, 1, 0)]


class Into:
    """Appends events to a file; fails for those of one entity as long as a file is there."""

    def __init__(self, at):
        self.at = str(at)

    def __call__(self, event):
        if event["entity_key"] == "bad" and os.path.exists(f"{self.at}/down"):
            raise ConnectionError("down")
        with open(f"{self.at}/taken", "a") as f:
            f.write(event["audit_log_id"] + "\n")


def _taken(at):
    return sorted(open(f"{at}/taken").read().split())


def test_outbox_isolates_a_failing_event(spark, tmp_path):
    source = f"file://{tmp_path}/q"
    (tmp_path / "down").touch()
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", handler=Into(tmp_path))
    enqueue(entries(spark, ("1", "a", 0, 0), ("2", "bad", 0, 0), ("3", "c", 0, 0)), source, "n0")
    run.flush()
    assert _taken(tmp_path) == ["1", "3"] and run.outbox.status().where("not delivered").first().error == "ConnectionError: down"
    (tmp_path / "down").unlink()
    enqueue(entries(spark, ("4", "d", 0, 0)), source, "n1")
    run.flush()
    assert _taken(tmp_path) == ["1", "2", "3", "4"] and run.outbox.deliver() == (0, 0)
    # a batch that is replayed between publishing and its commit: its events are known by their ids
    again = spark.read.parquet(f"{run.outbox.at}/events/batch=1")
    run.outbox.put(spark.createDataFrame(again.collect(), again.schema), 1)
    assert run.outbox.deliver() == (0, 0) and _taken(tmp_path) == ["1", "2", "3", "4"]


def test_outbox_gives_up_and_remakes_a_round_that_was_cut_short(spark, tmp_path):
    (tmp_path / "down").touch()
    box = Outbox(spark, f"file://{tmp_path}/box", Into(tmp_path), max_attempts=2)
    box.put(spark.createDataFrame([("1", "bad"), ("2", "ok")], "audit_log_id string, entity_key string"), 0)
    assert box.deliver() == (1, 1) and box.deliver() == (0, 1) and box.deliver() == (0, 0)
    assert [r.audit_log_id for r in box.failed().collect()] == ["1"] and box._open() == []
    cut = Outbox(spark, f"file://{tmp_path}/cut", Into(tmp_path))
    cut.put(spark.createDataFrame([("7", "ok")], "audit_log_id string, entity_key string"), 0)
    cut.deliver()
    for at in ("marks", "done"):
        cut.files.delete(f"{cut.at}/{at}")
    assert cut.deliver() == (1, 0) and _taken(tmp_path) == ["2", "7", "7"]  # once more, under the same id


def test_enqueue_is_whole_and_once(spark, tmp_path):
    source = f"file://{tmp_path}/q"
    two = entries(spark, ("1", "a", 0, 0), ("2", "b", 0, 0)).repartition(2)
    assert enqueue(two, source, "capture-1") == 2 and enqueue(two, source, "capture-1") == 0
    fs = Files(spark, source)
    names = [n for n in fs.names(source) if n.endswith(".parquet")]
    assert spark.read.schema(QUEUE).parquet(source).count() == 2 and all(n.startswith("capture-1-") for n in names)
    fs.delete(f"{source}-aside/capture-1/_moved")  # as if cut short before its end
    assert enqueue(two, source, "capture-1") == 2 and spark.read.schema(QUEUE).parquet(source).count() == 2
    narrow = spark.createDataFrame([("3", "T")], "id string, entity_type string")
    assert enqueue(narrow, source, "capture-2") == 1 and spark.read.schema(QUEUE).parquet(source).count() == 3


def test_failures_of_many_tasks_and_batches_come_back_in_few_files(spark, tmp_path, monkeypatch):
    """Entries that fail in every task of several batches are given up after as many rounds as they have attempts."""
    source, told = f"file://{tmp_path}/q", []
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", max_files=1, policy=Every(1), observers=[lambda *x: told.append(x)])
    for k in range(3):
        rows = [(f"{k}-{e}", f"e{e}", 1, k, {"before_json": "{"} if e % 2 else {}) for e in range(24)]
        enqueue(entries(spark, *rows).coalesce(1), source, f"n{k}")
    run.flush()
    assert [n for _, _, n in told] == [12, 12, 12]
    while run.redeliver():
        run.flush()
    assert told == [(0, 12, 12), (1, 12, 12), (2, 12, 12), (3, 0, 36), (4, 0, 36), (5, 0, 36), (6, 0, 36)]
    assert sorted((r.id, r.attempts) for r in run.dead().collect()) == sorted((f"{k}-{e}", 5) for k in range(3) for e in range(1, 24, 2))
    assert sorted(r.id for r in run.log().where("snapshot is not null").collect()) == sorted(f"{k}-{e}" for k in range(3) for e in range(0, 24, 2))
    # of entries that are larger than a file, earlier batches come first and by themselves
    monkeypatch.setattr("tidemark.streaming.dispatch.RETRY_FILE_BYTES", 1)
    queued = f"file://{tmp_path}/other"
    other = Dispatcher(spark, queued, run.out)
    assert other.redeliver() == 36 * 4
    assert {n[:27] for n in Files(spark, queued).names(queued) if n.endswith(".parquet")} == {f"retry-{k:010d}-{k:010d}" for k in range(7)}


def test_redelivery_that_was_cut_short_ends_once(spark, tmp_path):
    source = f"file://{tmp_path}/q"
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", max_files=1)
    for k in range(2):
        enqueue(entries(spark, (f"{k}", "a", 1, k, {"before_json": "{"})).coalesce(1), source, f"n{k}")
    run.flush()
    fs, aside = Files(spark, source), f"{source}-aside/retry-0000000000-0000000001"
    assert run.redeliver() == 2
    fs.delete(f"{aside}/_moved")  # as if cut short before its end, and more failed meanwhile
    enqueue(entries(spark, ("2", "a", 1, 2, {"before_json": "{"})).coalesce(1), source, "n2")
    run.flush()
    assert sorted((r.id, r.attempts) for n in (2, 3) for r in spark.read.parquet(f"{run.out}/retry/batch={n}").collect()) == [("0", 2), ("1", 2), ("2", 1)]
    assert run.redeliver() == 2 + 3 and run.redeliver() == 0
    back = spark.read.schema(QUEUE).parquet(source).where("attempts > 0")
    assert sorted((r.id, r.attempts) for r in back.collect()) == [("0", 1), ("0", 2), ("1", 1), ("1", 2), ("2", 1)]
    # a queue of before, which had a name for each batch
    old = Dispatcher(spark, f"file://{tmp_path}/old", run.out)
    enqueue(spark.read.schema(QUEUE).parquet(f"{run.out}/retry/batch=0"), old.source, "retry-0000000000")
    assert old.redeliver() == 4 and old.redeliver() == 0


class Calls:
    """A history's state that tells what was asked of it."""

    def __init__(self, value=None):
        self.value, self.told = value, []

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.told.append("get")
        return self.value

    def exists(self):
        self.told.append("exists")
        return self.value is not None

    def update(self, value):
        self.told.append("update")
        self.value = value


def test_state_is_asked_for_only_where_updates_count():
    made = Row("id", "action", "occurred_on_utc", "error")
    for rows, before, told, after, due in (
        ([made("1", 0, T0, None), made("2", 1, T0, "bad"), made("3", 2, T0, None)], (1, None), [], (1, None), set()),
        ([made("2", 1, T0, None), made("1", 1, T0, None), made("3", 1, T0, None)], None, ["get", "update"], (1, 1704067200000000), {"2"}),
        ([made("1", 1, T0, None)], (1, None), ["get", "update"], (0, 1704067200000000), {"1"}),
    ):
        cursor, state = _Cursor(Every(2), ["id", "action", "occurred_on_utc", "error"]), Calls(before)
        cursor.init(state)
        assert {r.id for r in cursor.handleInputRows(None, iter(rows), None) if r.snapshot_due} == due
        assert (state.told, state.value) == (told, after)


def test_state_is_stored_by_its_changes_and_the_session_stays_as_it_was(spark, tmp_path):
    was, source = dict(spark.conf.getAll), f"file://{tmp_path}/q"
    run = Dispatcher(spark, source, f"file://{tmp_path}/out", policy=Every(1))
    enqueue(entries(spark, ("1", "a", 1, 0), ("2", "b", 1, 0)), source, "n0")
    run.flush()
    assert any(f.endswith(".changelog") for _, _, names in os.walk(f"{tmp_path}/out/checkpoint/state") for f in names)
    assert dict(spark.conf.getAll) == was and run.log().where("snapshot is not null").count() == 2


def test_state_takes_no_disk_ahead(spark):
    """Each flush opens its state anew, and a state's files aren't gone at once: together they held 250 MB for 366 rows."""

    class Writer:
        def start(self):
            return spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", None)

    assert started(Writer(), spark) == "false" and Writer().start() is None


DEEP = '{"a":' * 5000 + "1" + "}" * 5000


def test_poison_ends_as_an_error(spark, tmp_path):
    for bad in (DEEP, "[" * 100_000, '{"a":' * 100_000):
        with pytest.raises(ValueError):
            jp.parse(bad)
    assert jp.parse('{"s":"' + "[{" * 5000 + '"}') and jp.parse("[" + ",".join(["{}"] * 5000) + "]")
    assert jp.dump(jp.parse('{"a":"\\ud800","\\udc00":"\\ud83d\\ude00"}')) == '{"a":"\\ud800","\\udc00":"😀"}'
    for patch in ('[{"op":"add","path":5,"value":1}]', '[{"op":5,"path":"/a"}]', '[{"op":"move","path":"/a"}]', '[{"op":"move","path":7,"from":"/b"}]', '[{"op":"copy","path":"/a","from":null}]', '[{"op":"remove","path":null}]', '[{"op":"test","path":[]}]', "[[]]", "5"):
        with pytest.raises(jp.PatchError):
            jp.apply({"b": 1}, patch)
    inner = '{"a":' * 490 + "1" + "}" * 490
    with pytest.raises(jp.PatchError):  # patches put values into each other
        doc = {}
        for k in range(9):
            doc = jp.apply(doc, f'[{{"op":"add","path":"{"/a" * 490 * k or "/b"}","value":{inner}}}]') if k else jp.parse(inner)
        jp.dump(doc)
    records = spark.createDataFrame([("1", DEEP), ("2", '{"s":"\\ud800"}'), ("3", '{"ok":1}')], "id string, after_json string")
    records = records.selectExpr("id", "'T' entity_type", "id entity_id", "0 action", "timestamp_ntz '2024-01-01' occurred_on_utc", "cast(null as string) user_id", "cast(null as string) tenant_id", "id source_id", "cast(null as string) before_json", "after_json")
    got = {r.id: (r.diff, r.error is None) for r in importer.imported(records, records.selectExpr("id correlation_id").where("false"), "b").collect()}
    assert got == {"1": ("[]", False), "2": ('[{"op":"add","path":"/s","value":"\\ud800"}]', True), "3": ('[{"op":"add","path":"/ok","value":1}]', True)}
    enqueue(entries(spark, ("1", "a", 0, 0, {"after_json": DEEP, "attempts": 4}), ("2", "b", 0, 0)), f"file://{tmp_path}/q", "n")
    run = Dispatcher(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/out")
    run.flush()
    assert [r.id for r in run.dead().collect()] == ["1"] and [r.id for r in run.log().collect()] == ["2"]
