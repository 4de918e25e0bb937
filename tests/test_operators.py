"""Scenarios on small hand-written logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as cn
from tidemark.operators import aggregate, capture, compaction, export, filters, integrity, replay, retention, view
from tidemark.operators.query import HistoryQuery, newest_first, oldest_first
from tidemark.schema import AUDIT_LOG, COLUMNS, HistoryError

T0 = dt.datetime(2024, 1, 1)
KEY = b"0123456789abcdef"


def log(spark, *rows):
    """Rows of (id, entity, action, hours) and other columns by name."""
    made = []
    for entry in rows:
        (id_, entity, action, hours), more = entry[:4], entry[4] if len(entry) > 4 else {}
        base = dict.fromkeys(COLUMNS) | {"id": id_, "entity_type": "Order", "entity_id": entity, "action": action, "occurred_on_utc": T0 + dt.timedelta(hours=hours), "diff": "[]"}
        made.append(tuple((base | more)[c] for c in COLUMNS))
    return spark.createDataFrame(made, AUDIT_LOG)


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def seven(spark):
    change = lambda p: {"diff": f'[{{"op":"replace","path":"{p}","value":{{"path":"/status"}}}}]'}
    return log(
        spark,
        ("1", "o1", 0, 0, {"user_id": "alice", "tenant_id": "t1", "correlation_id": "A"}), ("2", "o1", 1, 1, {"user_id": "bob", "tenant_id": "t1", "correlation_id": "A"} | change("/status")),
        ("3", "o1", 1, 24, {"user_id": "alice", "tenant_id": "t1", "correlation_id": "B"} | change("/total")), ("4", "o2", 2, 26, {"user_id": None, "tenant_id": "t1"}),
        ("5", "c1", 0, 48, {"entity_type": "Customer", "user_id": "alice", "tenant_id": "t2"} | change("/address/city")), ("6", "c1", 1, 51, {"entity_type": "Customer", "user_id": "bob", "tenant_id": ""} | change("/statusCode")),
        ("7", "i1", 0, 53, {"entity_type": "Invoice", "user_id": "system", "user_type": "job"}),
    )


def test_filters(seven):
    at = lambda f: sorted(ids(seven.transform(f)))
    assert at(filters.between_dates(T0, T0 + dt.timedelta(hours=1))) == ["1", "2"]
    assert at(filters.within_last(dt.timedelta(hours=5), T0 + dt.timedelta(hours=53))) == ["5", "6", "7"]
    assert at(filters.changed_path("/status")) == ["2"] and at(filters.changed_path("/address")) == ["5"]
    assert at(filters.by_users(["alice"])) == ["1", "3", "5"] and at(filters.by_users([])) == []
    assert at(filters.tenant_scope(None)) == ["6", "7"] and at(filters.tenant_scope("t2")) == ["5"]
    assert len(at(filters.tenant_scope(filters.AllTenants))) == 7
    for bad in ("status", "/a~2", "/a~"):
        with pytest.raises(ValueError):
            filters.changed_path(bad)
    with pytest.raises(ValueError):
        filters.between_dates(T0, T0 - dt.timedelta(days=1))
    with pytest.raises(ValueError):
        filters.within_last(dt.timedelta(0), T0)


def test_query_order_and_page(seven):
    q = HistoryQuery(sort_by="user_id", newest_first=True, take=3)
    assert ids(q.page(seven)) == ["7", "6", "2"]
    assert ids(HistoryQuery(sort_by="user_id", newest_first=False, skip=4).page(seven)) == ["6", "7", "4"]
    assert HistoryQuery(take=5, skip=2).meta(seven).first()[:] == (7, 5, False)
    assert HistoryQuery(take=5, skip=1).meta(seven).first()[:] == (7, 5, True)
    assert [r.id for r in HistoryQuery(newest_first=False).pages(seven, 2)] == list("1234567")
    for bad in ({"take": 0}, {"skip": -1}, {"sort_by": "x"}, {"from_utc": T0, "to_utc": T0 - dt.timedelta(1)}):
        with pytest.raises(ValueError):
            HistoryQuery(**bad)


def test_chain_order_of_ties(spark):
    df = log(spark, ("a", "o", 1, 0), ("b", "o", 1, 0, {"chain_sequence": 2}), ("c", "o", 1, 0, {"chain_sequence": 1}), ("d", "o", 0, -1))
    assert ids(df.transform(oldest_first())) == ["d", "c", "b", "a"] and ids(df.transform(newest_first())) == ["a", "b", "c", "d"]


def test_top_lists(seven):
    assert [tuple(r) for r in aggregate.top_actors(seven, 2).collect()] == [("alice", 3), ("bob", 2)]
    assert [r.user_id for r in aggregate.rollup_by_day_and_user(seven, 1).collect()] == ["alice", "alice", "alice"]
    with pytest.raises(ValueError):
        aggregate.top_actors(seven, 0)
    assert {(r.key, r["count"]) for r in aggregate.by_column(seven, "tenant_id").collect()} == {("t1", 4), ("t2", 1), ("", 1), (None, 1)}


def _patch(op, path, value="null"):
    return {"diff": f'[{{"op":"{op}","path":"{path}"' + (f',"value":{value}' if op != "remove" else "") + "}]"}


def test_replay(spark):
    df = log(
        spark,
        ("01", "a", 0, 0, _patch("add", "/s", '"new"')), ("02", "a", 1, 1, _patch("replace", "/s", '"paid"')), ("03", "a", 2, 5),
        ("04", "b", 0, 0, _patch("add", "/l", "[1]")), ("05", "b", 1, 2, _patch("add", "/l/-", '{"x":null}') | {"snapshot": '{"l":[9],"é":1.50}'}), ("06", "b", 1, 3, _patch("add", "/l/-", "2")),
        ("07", "c", 1, 0, _patch("add", "/s", "1")), ("08", "d", 0, 0, _patch("remove", "/s")), ("09", "e", 0, 9), ("10", "f", 0, 0, {"diff": "[] junk"}), ("11", "g", 3, 0), ("12", "g", 0, 1, _patch("add", "/back", "true")),
    )
    got = {r.entity_id: (r.state, r.error) for r in replay.reconstruct(df, T0 + dt.timedelta(hours=4)).collect()}
    assert got["a"] == ('{"s":"paid"}', None) and got["b"][0] == '{"l":[9,2],"é":1.50}' and "e" not in got
    assert got["c"][1] and got["d"][1] and got["f"][1] and got["c"][0] is None and got["g"][1]
    later = {r.entity_id: r.state for r in replay.reconstruct(df, T0 + dt.timedelta(hours=6)).collect()}
    assert later["a"] is None
    many = {r.entity_id: r.state for r in replay.reconstruct_many(df, spark.createDataFrame([("a",), ("zz",)], "entity_id string"), "Order", T0).collect()}
    assert many == {"a": '{"s":"new"}', "zz": None}


def test_flat_replay_equals_the_fold(spark):
    r, rows = random.Random(3), []
    for k in range(300):
        state, hours = set(), 0
        for j in range(r.randrange(1, 8)):
            path = r.choice(["x", "y", "z"])
            op = "add" if path not in state else r.choice(["replace", "remove", "add"])
            (state.discard if op == "remove" else state.add)(path)
            hours += r.choice([0, 1])
            rows.append((f"{len(rows):06d}", f"e{k}", 0 if j == 0 else r.choice([1, 1, 1, 2]), hours, _patch(op, f"/{path}", r.choice(["1", "null", '"s"', '{"q":[1]}', "2.5"])) | {"tenant_id": r.choice([None, ""])}))
    df = log(spark, *rows)
    assert replay.is_flat(df).first().flat
    flat = {}
    for x in replay.reconstruct_flat(df, T0 + dt.timedelta(hours=99)).collect():
        flat.setdefault(x.entity_id, {})[x.path[1:]] = x.value
    import json

    fold = {x.entity_id: {k: json.dumps(v, separators=(",", ":")) for k, v in json.loads(x.state).items()} for x in replay.reconstruct(df, T0 + dt.timedelta(hours=99)).collect() if x.state}
    assert flat == {k: v for k, v in fold.items() if v}


def test_compaction(spark):
    df = log(
        spark, ("1", "a", 0, 0, _patch("add", "/s", "1")), ("2", "a", 1, 1, _patch("add", "/t", "2") | {"error": "x"}), ("3", "a", 1, 2, _patch("replace", "/s", "3")),
        ("4", "b", 0, 0), ("5", "b", 2, 1), ("6", "c", 0, 0), ("7", "d", 0, 0, {"entry_hash": "h"}), ("8", "d", 1, 1, {"entry_hash": "i"}),
    )
    got = {r.id: (r.action, r.diff, r.snapshot, r.error) for r in compaction.compact(df, 1).collect()}
    assert got["2"] == (0, "[]", '{"s":1,"t":2}', None) and "1" not in got and got["3"][1] != "[]"
    assert set(got) == {"2", "3", "4", "5", "6", "7", "8"}
    whole = {r.id: r for r in compaction.compact(df, 0).collect()}
    assert whole["5"].action == 2 and whole["5"].snapshot == "{}" and set(whole) == {"3", "5", "6", "7", "8"}
    states = lambda x: {r.entity_id: r.state for r in replay.reconstruct(x, T0 + dt.timedelta(days=1)).collect()}
    assert states(compaction.compact(df, 0))["a"] == states(df)["a"] == '{"s":3,"t":2}'
    with pytest.raises(Exception, match="can't be replayed"):
        compaction.compact(log(spark, ("1", "a", 0, 0, _patch("remove", "/s")), ("2", "a", 1, 1)), 0).collect()
    with pytest.raises(ValueError):
        compaction.ranked(df, -1)
    assert issubclass(HistoryError, Exception)


def test_flat_replay_keeps_values_as_written(spark):
    values = ['{"b":1,"a":1.10}', "12345678901234567890.123", '"1"', "1", "null", "true", '"q\\"é"', "[]"]
    df = log(spark, *[(f"{k}", f"e{k}", 0, 0, _patch("add", "/x", v)) for k, v in enumerate(values)])
    at = T0 + dt.timedelta(hours=1)
    flat = {r.entity_id: r.value for r in replay.reconstruct_flat(df, at).collect()}
    assert flat == {f"e{k}": v for k, v in enumerate(values)}
    assert {r.entity_id: r.state for r in replay.reconstruct(df, at).collect()} == {k: f'{{"x":{v}}}' for k, v in flat.items()}


def test_a_long_history_replays_in_linear_time(spark):
    import time

    ids = spark.range(100_000).select(F.format_string("%07d", "id").alias("id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("occurred_on_utc"), F.when(F.col("id") == 0, 0).otherwise(1).alias("action"), F.when(F.col("id") == 99_000, '{"x":0}').alias("snapshot"))
    df = ids.select("*", F.lit("Order").alias("entity_type"), F.lit("o").alias("entity_id"), F.lit(None).cast("string").alias("tenant_id"), F.lit('[{"op":"add","path":"/y","value":1.0}]').alias("diff"))
    began = time.time()
    assert [r.state for r in replay.reconstruct(df, "2024-12-01T00:00:00").collect()] == ['{"x":0,"y":1.0}']
    assert time.time() - began < 20


def test_retention(spark, tmp_path):
    df = log(spark, *[(str(k), "a", 1, k, {"tenant_id": "t1" if k % 2 else None}) for k in range(8)])
    now = T0 + dt.timedelta(hours=10)
    assert ids(retention.expired(df, retention.RetainFor(dt.timedelta(hours=8)), now)) == ["0", "1"]
    assert ids(retention.expired(df, retention.RetainCount(3), now)) == ["0", "1"]
    assert ids(retention.expired(df, retention.RetainFor(dt.timedelta(hours=1)), now, 3)) == ["0", "1", "2"]
    by = retention.PerTenant({"t1": retention.PerEntityType({"Order": retention.RetainCount(1)})}, retention.RetainFor(dt.timedelta(hours=7)))
    assert ids(retention.expired(df, by, now)) == ["0", "1", "2", "3", "5"]
    archive, out = str(tmp_path / "archive"), str(tmp_path / "log")
    options = retention.SweepOptions(archivers=[retention.copy_to(archive, lambda v: v.select("id"))])
    assert retention.sweep(df, retention.RetainCount(3), now, out, options) == 2
    assert sorted(ids(spark.read.parquet(out))) == list("234567") and sorted(ids(spark.read.parquet(archive))) == ["0", "1"]
    assert retention.sweep(df, retention.RetainCount(3), now, out, retention.SweepOptions(dry_run=True)) == 2


def _chain(spark, n=5):
    df = log(spark, *[(f"{s}{k}", s, 0 if k == 0 else 1, k, {"user_id": "é", "tenant_id": None if k % 2 else ""}) for s in "ab" for k in range(n)])
    stamped = integrity.stamp(df, integrity.no_anchors(df), 1, KEY).cache()
    return stamped, integrity.advanced_anchors(integrity.no_anchors(df), stamped).cache()


def _first(df, anchors, keys={1: KEY}):  # noqa: B006
    r = integrity.verify_chain(df, anchors, keys).first()
    return r.is_valid, r.verified, r.reason, r.break_id


def test_chain_and_tampering(spark):
    df, anchors = _chain(spark)
    assert _first(df, anchors) == (True, 10, "None", None)
    change = lambda where, **c: df.select(*[F.when(F.expr(where), F.lit(c[x])).otherwise(F.col(x)).alias(x) if x in c else F.col(x) for x in df.columns])
    assert _first(change("id = 'b2'", user_id="eve"), anchors) == (False, 7, "ContentMismatch", "b2")
    assert _first(df.where("id != 'a2'"), anchors) == (False, 2, "BrokenLink", "a3")
    assert _first(df.where("id != 'a4'"), anchors) == (False, 4, "Truncated", "a3")
    assert _first(df.where("entity_id != 'b'"), anchors)[:3] == (False, 5, "Truncated")
    assert _first(change("id = 'a3'", entry_hash=None), anchors) == (False, 3, "MissingHashAfterChainStart", "a3")
    assert _first(change("id = 'a1'", hash_key_id=9), anchors) == (False, 1, "UnknownKey", "a1")
    assert _first(df, anchors, {}) == (False, 0, "UnknownKey", "a0")
    legacy = log(spark, ("old", "a", 0, -5))
    assert _first(df.unionByName(legacy), anchors)[0]


def test_native_hash_equals_the_library(spark):
    import hashlib
    import hmac

    for key in (KEY, b"k" * 200):
        texts = ["", "a", "é🙂" * 100, "x" * 5000]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cn.hmac_sha256(key, F.col("t"))).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    with pytest.raises(ValueError):
        cn.chain_key("c2hvcnQ=")


def test_pruning_keeps_the_chain(spark):
    df, anchors = _chain(spark)
    victims = integrity.prunable(df.where("id in ('a0', 'a1', 'a3', 'b1', 'b2')"), anchors)
    assert sorted(ids(victims)) == ["a0", "a1"]
    after = integrity.pruned_anchors(anchors, victims)
    assert _first(retention.survivors(df, victims), after) == (True, 8, "None", None)
    assert integrity.valid_anchors(after).count() == 2
    with pytest.raises(HistoryError):
        integrity.valid_anchors(after.withColumn("pruned_through_hash", F.lit(None).cast("string")))
    new = log(spark, ("a9", "a", 1, 20))
    more = integrity.stamp(new, after, 1, KEY)
    assert more.first().chain_sequence == 6
    assert _first(retention.survivors(df, victims).unionByName(more), integrity.advanced_anchors(after, more))[0]


def test_walk_order_equals_a_merge(spark):
    r, rows = random.Random(7), []
    for s in range(60):
        for k in range(r.randrange(1, 9)):
            rows.append((f"{len(rows):05d}", f"s{s}", 1, r.randrange(6), {"chain_sequence": k if r.random() < 0.6 else None}))
    want = {}
    for s in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == s]
        chained = sorted((x for x in own if x[4]["chain_sequence"] is not None), key=lambda x: (x[4]["chain_sequence"], x[0]))
        loose = sorted((x for x in own if x[4]["chain_sequence"] is None), key=lambda x: (x[3], x[0]))
        out, reached = [], None
        while chained or loose:  # a loose row goes once its time is before the chain's
            ahead = chained and max(chained[0][3], reached if reached is not None else chained[0][3])
            if not chained or loose and loose[0][3] < ahead:
                out.append(loose.pop(0)[0])
            else:
                reached = ahead
                out.append(chained.pop(0)[0])
        want |= {x: k + 1 for k, x in enumerate(out)}
    assert {x.id: x.walk for x in integrity.walk_order(log(spark, *rows)).collect()} == want


def test_views_and_export_of_bad_json(spark, tmp_path):
    df = log(spark, ("1", "a", 1, 0, {"diff": '[{"op":"add","path":"/a~1b/c","value":"x"},{"op":"fly","path":"/q"},{"op":"remove","path":"/r"},{"path":"/no"},7]', "user_id": 'q"\n'}), ("2", "a", 1, 1, {"diff": "[] junk"}), ("3", "a", 1, 2, {"diff": "{}", "snapshot": "NaN"}))
    got = {r.id: r.changes for r in view.render_many(df, labels={"a/b": "Label"}).collect()}
    assert [(c.path, c.new_value, c.kind, c.label) for c in got["1"]] == [("/a~1b/c", "x", "Added", "Label"), ("/q", None, "Modified", None), ("/r", None, "Removed", None)] or got["1"] == []
    assert got["2"] == [] and got["3"] == []
    import json

    lines = {r.id: json.loads(r.line) for r in export.ndjson(df).collect()}
    assert lines["2"]["diff"] == "[] junk" and lines["3"]["diff"] == {} and lines["3"]["snapshot"] == "NaN" and lines["1"]["userId"] == 'q"\n'
    export.write_ndjson(df, str(tmp_path / "out"))
    assert sorted(ids(export.read_ndjson(spark, str(tmp_path / "out")))) == ["1", "2", "3"]
    back = export.read_ndjson(spark, str(tmp_path / "out"))
    kept = ["id", "action", "occurred_on_utc", "user_id", "entity_type"]
    assert dict(back.dtypes)["action"] == "int" and dict(back.dtypes)["occurred_on_utc"] == "timestamp_ntz"
    assert sorted(back.select(*kept).collect()) == sorted(df.select(*kept).collect())


def test_is_json(spark):
    cases = {"{}": True, "[1]": True, " 1 ": True, "null": True, '"x"': True, "": False, "[] x": False, "{'a':1}": False, "NaN": False, "{": False, "1,2": False, "[1,]": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert [(r.t, r.got) for r in df.select("t", cn.is_json(F.col("t")).alias("got")).collect()] == list(cases.items())


def test_rules_and_keys(spark):
    config = capture.EntityConfig("T", ("k",), excluded=frozenset({"x"}), hashed=frozenset({"x", "h"}), redacted=frozenset({"h", "r"}))
    assert [config.rule(c) for c in "xhrk"] == ["exclude", "hash", "redact", "capture"]
    before = spark.createDataFrame([(1, "a", "b", "c", 1.5), (2, "a", "b", "c", None)], "k int, x string, h string, r string, v double")
    after = spark.createDataFrame([(1, "other", "b", "other", 1.5), (2, "a", "new", "c", 2.0)], before.schema)
    rows = {r.entity_id: r for r in capture.capture(before, after, config).collect()}
    assert rows["1"].diff == "[]" and rows["1"].action == 1  # only excluded and redacted columns changed
    assert '"op":"replace","path":"/h"' in rows["2"].diff and '"/v","value":2.0' in rows["2"].diff and "new" not in rows["2"].diff
    registry = capture.Registry()
    registry.register(config)
    assert registry.is_audited("T") and not registry.is_audited("U")
