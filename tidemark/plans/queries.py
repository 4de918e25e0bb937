"""Every operator as a query over the test tables, and SQL that gives the same rows.

The audit log is derived from the table events (sources.derived), by the same rules in both.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as cn
from ..operators import aggregate as ag
from ..operators import capture as cp
from ..operators import compaction, export, importer, integrity, metrics, pathindex, replay, retention, sweeps, view
from ..operators import filters as f
from ..operators.query import HistoryQuery
from ..schema import STREAM, tenant
from ..sources import derived
from ..sources.shared import folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = dt.datetime(2024, 1, 31)
KEY = bytes(range(32))

_AS_OF = "2024-01-20T00:00:00"
_IDS = "id, entity_type, entity_id, action, occurred_on_utc"


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_log(name: str, apply: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the derived log; sql follows its common table expressions."""
    _register(name, lambda spark, d: apply(derived.audit_log(spark, d)), f"WITH {derived.AUDIT_LOG_SQL} {sql}" if sql else None)


def filtered(name: str, apply: f.Filter, where: str) -> None:
    on_log(name, lambda df: apply(df).select(*_IDS.split(", ")), f"SELECT {_IDS} FROM audit_log WHERE {where}")


# filters
filtered("between_dates", f.between_dates(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 6)), "occurred_on_utc BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00'")
filtered("within_last", f.within_last(dt.timedelta(days=5), NOW), "occurred_on_utc >= TIMESTAMP '2024-01-26 00:00:00'")
filtered("by_user", f.by_user("u7"), "user_id = 'u7'")
filtered("by_users", f.by_users(["u1", "u2", "u24"]), "user_id IN ('u1', 'u2', 'u24')")
filtered("by_user_type", f.by_user_type("job"), "user_type = 'job'")
filtered("by_tenant", f.by_tenant("t1"), "tenant_id = 't1'")
filtered("by_action", f.by_action(2), "action = 2")
filtered("by_correlation", f.by_correlation("corr-12"), "correlation_id = 'corr-12'")
filtered("matching", f.matching("length(diff) > 60 and user_type = 'user'"), "length(diff) > 60 AND user_type = 'user'")
filtered("audit_for_base", f.audit_for("shop.Sales"), "entity_type = 'shop.Sales' OR entity_base_type = 'shop.Sales'")
filtered("no_tenant", f.no_tenant(), "coalesce(tenant_id, '') = ''")
filtered("tenant_scope_fail_closed", f.tenant_scope(None), "tenant_id IS NULL OR tenant_id = ''")
filtered("tenant_scope_one", f.tenant_scope("t2"), "tenant_id = 't2'")
filtered("tenant_scope_all", f.tenant_scope(f.AllTenants), "true")
_CITY = " OR ".join(f"""contains(diff, '"op":"{v}","path":"/city{e}')""" for v in ("add", "remove", "replace", "move", "copy", "test") for e in ('"', "/"))
filtered("changed_path", f.changed_path("/city"), _CITY)
filtered("changed_path_nested", f.changed_path("/valueCode"), _CITY.replace("/city", "/valueCode"))



def _indexed(df: DataFrame) -> DataFrame:
    """The same by an index, of a log written in two parts of which one never changes the path."""
    log = pathindex.IndexedLog(df.sparkSession, folder(df.sparkSession))
    often = F.substring("id", 25, 12).cast("long") % 5 == 0
    log.append(df.where(often))
    log.append(df.where(~often))
    return log.changed_path("/city").select(*_IDS.split(", "))


on_log("changed_path_indexed", _indexed, f"SELECT {_IDS} FROM audit_log WHERE {_CITY}")

# the history query
_RICH = HistoryQuery(user_type="user", entity_types=("shop.Order", "shop.Session"), actions=(0, 1), from_utc=dt.datetime(2024, 1, 3), to_utc=dt.datetime(2024, 1, 28), changed_path="/city", take=50, skip=10)
_RICH_WHERE = f"user_type = 'user' AND entity_type IN ('shop.Order', 'shop.Session') AND action IN (0, 1) AND occurred_on_utc >= TIMESTAMP '2024-01-03' AND occurred_on_utc <= TIMESTAMP '2024-01-28' AND ({_CITY})"
on_log("history_page", lambda df: _RICH.page(df).select(*_IDS.split(", ")), f"SELECT {_IDS} FROM audit_log WHERE {_RICH_WHERE} ORDER BY occurred_on_utc DESC, id DESC LIMIT 50 OFFSET 10")
on_log("page_meta", _RICH.meta, f"SELECT t AS total, greatest(0, least(50, t - 10)) AS items, greatest(0, least(50, t - 10)) + 10 < t AS has_more FROM (SELECT count(*) AS t FROM audit_log WHERE {_RICH_WHERE})")
_SCALAR = HistoryQuery(entity_type="shop.Order", entity_base_type="shop.Sales", action=1, tenant_id="t1", user_id="u3", take=500)
on_log("history_scalar_filters", lambda df: _SCALAR.page(df).select(*_IDS.split(", ")), f"SELECT {_IDS} FROM audit_log WHERE entity_type = 'shop.Order' AND entity_base_type = 'shop.Sales' AND action = 1 AND tenant_id = 't1' AND user_id = 'u3' ORDER BY occurred_on_utc DESC, id DESC LIMIT 500")
for _name, _field, _newest, _order in (
    ("sort_by_user_nulls_last", "user_id", True, "user_id DESC NULLS LAST, occurred_on_utc DESC, id DESC"),
    ("sort_by_user_ascending", "user_id", False, "user_id ASC NULLS LAST, occurred_on_utc, id"),
    ("sort_by_entity_type", "entity_type", False, "entity_type, occurred_on_utc, id"),
    ("sort_by_action", "action", True, "action DESC, occurred_on_utc DESC, id DESC"),
    ("oldest_page", "occurred_on", False, "occurred_on_utc, id"),
):
    on_log(_name, lambda df, q=HistoryQuery(sort_by=_field, newest_first=_newest, skip=20, take=120): q.page(df).select(*_IDS.split(", "), "user_id"), f"SELECT {_IDS}, user_id FROM audit_log ORDER BY {_order} LIMIT 120 OFFSET 20")


def _walked(df: DataFrame) -> DataFrame:
    """A whole order in six pages, each from the cursor of the one before it."""
    log = stored(df)
    query, cursor, out = HistoryQuery(sort_by="user_id", take=-(-log.count() // 6)), None, None
    for k in range(6):
        page = stored(query.page_after(log, cursor).select("id", "user_id", "occurred_on_utc", F.lit(k).alias("page")))
        out = page if out is None else out.unionByName(page)
        found = page.orderBy(F.col("user_id").asc_nulls_first(), "occurred_on_utc", "id").limit(1).collect()
        if not found:
            break
        cursor = query.cursor(found[0])
    return out.select("id", "page")


on_log("keyset_pages", _walked, "SELECT id, CAST((row_number() OVER (ORDER BY user_id DESC NULLS LAST, occurred_on_utc DESC, id DESC) - 1) // CAST(ceil(count(*) OVER () / 6) AS BIGINT) AS INTEGER) AS page FROM audit_log")

# counts and rollups
for _c in ("entity_type", "user_id", "tenant_id"):
    on_log(f"agg_{_c}", lambda df, c=_c: ag.by_column(df, c), f'SELECT {_c} AS key, count(*) AS "count" FROM audit_log GROUP BY 1')
_NAMES = "CASE action WHEN 0 THEN 'Inserted' WHEN 1 THEN 'Updated' WHEN 2 THEN 'Deleted' ELSE 'SoftDeleted' END"
on_log("agg_action", lambda df: ag.by_column(df, "action"), f'SELECT {_NAMES} AS key, count(*) AS "count" FROM audit_log GROUP BY 1')
for _c in ag.BUCKETS:
    on_log(f"agg_{_c}", lambda df, c=_c: ag.by_time(df, c), f"""SELECT CAST(date_trunc('{_c}', occurred_on_utc) AS TIMESTAMP) AS bucket_start_utc, strftime(date_trunc('{_c}', occurred_on_utc), '%Y-%m-%dT%H:%M:%S.0000000Z') AS key, count(*) AS "count" FROM audit_log GROUP BY 1, 2""")
on_log("rollup_day", ag.rollup_by_day, 'SELECT CAST(occurred_on_utc AS DATE) AS day, count(*) AS "count" FROM audit_log GROUP BY 1')
on_log("rollup_month", ag.rollup_by_month, 'SELECT CAST(year(occurred_on_utc) AS INTEGER) AS "year", CAST(month(occurred_on_utc) AS INTEGER) AS "month", count(*) AS "count" FROM audit_log GROUP BY 1, 2')
on_log("rollup_day_action", ag.rollup_by_day_and_action, 'SELECT CAST(occurred_on_utc AS DATE) AS day, action, count(*) AS "count" FROM audit_log GROUP BY 1, 2')
_DAY_USER = "SELECT CAST(occurred_on_utc AS DATE) AS day, user_id, count(*) AS activity_count FROM audit_log WHERE user_id IS NOT NULL GROUP BY 1, 2"
on_log("rollup_day_user_topn", lambda df: ag.rollup_by_day_and_user(df, 3), f"SELECT * FROM ({_DAY_USER}) QUALIFY row_number() OVER (PARTITION BY day ORDER BY activity_count DESC, user_id) <= 3")
on_log("top_actors", lambda df: ag.top_actors(df, 5), "SELECT user_id, count(*) AS activity_count FROM audit_log WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
on_log("distinct_users", ag.distinct_users, "SELECT DISTINCT user_id FROM audit_log WHERE user_id IS NOT NULL")
_SIZES = "SELECT entity_type, entity_id, coalesce(tenant_id, '') AS tenant, count(*) AS total FROM audit_log GROUP BY 1, 2, 3"
on_log("compaction_candidates", lambda df: compaction.candidates(df, 20, None), f"SELECT * FROM ({_SIZES}) WHERE total > 20")
on_log("oversized_groups", lambda df: ag.oversized(df, 15), "SELECT entity_type, entity_id, tenant_id, count(*) AS total FROM audit_log GROUP BY 1, 2, 3 HAVING count(*) > 15")
on_log("queue_depth", lambda df: ag.queue_depth(df.withColumn("error", F.when(F.col("action") == 2, "x"))), "SELECT count(*) FILTER (action <> 2) AS waiting, count(*) FILTER (action = 2) AS dead FROM audit_log")

# views, events, keys and rules
on_log("to_event", view.to_event, f"SELECT id AS audit_log_id, entity_type, entity_id AS entity_key, {_NAMES} AS action, occurred_on_utc AS at, tenant_id, user_id, correlation_id, nullif(diff, '[]') AS diff FROM audit_log")
_LABELS = {"value": "Value", "city": "City"}
_CHANGES = """SELECT id, json_extract_string(c, '$.path') AS path, json_extract_string(c, '$.value') AS new_value,
 CASE json_extract_string(c, '$.op') WHEN 'add' THEN 'Added' WHEN 'remove' THEN 'Removed' ELSE 'Modified' END AS kind,
 CASE json_extract_string(c, '$.path') WHEN '/value' THEN 'Value' WHEN '/city' THEN 'City' END AS label
 FROM (SELECT id, unnest(json_extract(diff, '$[*]')) AS c FROM audit_log)"""
on_log("field_changes", lambda df: df.select("id", F.explode(view.changes(F.col("diff"), _LABELS)).alias("c")).select("id", "c.path", "c.new_value", "c.kind", "c.label"), _CHANGES)
on_log(
    "rendered_view",
    lambda df: view.render_many(df, labels=_LABELS, custom=("correlation_id",)).select("id", "entity_label", "action", "user", F.size("changes").alias("n_changes"), F.col("custom_columns")["correlation_id"].alias("custom")),
    f"""SELECT id, entity_type AS entity_label, {_NAMES} AS action, user_id AS "user", CAST(json_array_length(diff) AS INTEGER) AS n_changes, correlation_id AS custom FROM audit_log""",
)
on_log("viewer_log_page", lambda df: view.log_page(df, 3, 25).select("id", "action", "occurred_on_utc"), f"SELECT id, {_NAMES} AS action, occurred_on_utc FROM audit_log ORDER BY occurred_on_utc DESC, id DESC LIMIT 25 OFFSET 50")
on_log("viewer_meta", view.meta, "SELECT entity_type, count(*) AS rows FROM audit_log GROUP BY 1")
_register("composite_key", lambda spark, d: derived.table(spark, d, "customer").select("c_custkey", cp.entity_key(F.concat(F.col("c_mktsegment"), F.lit("|x")), F.col("c_nationkey"), F.lit("en")).alias("entity_id"), cp.entity_key(F.col("c_name")).alias("single")), "SELECT c_custkey, replace(c_mktsegment || '|x', '|', '%7C') || '|' || CAST(c_nationkey AS VARCHAR) || '|en' AS entity_id, c_name AS single FROM customer")
CUSTOMER = cp.EntityConfig("shop.Customer", ("c_custkey",), "shop.Party", excluded=frozenset({"c_nationkey"}), hashed=frozenset({"c_name"}), redacted=frozenset({"c_mktsegment"}), labels={"c_acctbal": "Balance"})
_register(
    "field_rules",
    lambda spark, d: derived.table(spark, d, "customer").select("c_custkey", cp.ruled(F.col("c_name"), "string", "hash").alias("hashed"), cp.ruled(F.col("c_mktsegment"), "string", "redact").alias("redacted"), cp.ruled(F.col("c_nationkey"), "int", "hash").alias("hashed_number")),
    """SELECT c_custkey, '"' || sha256(c_name) || '"' AS hashed, '"<redacted>"' AS redacted, '"' || sha256(CAST(c_nationkey AS VARCHAR)) || '"' AS hashed_number FROM customer""",
)

# capture
_PLAIN = cp.EntityConfig("shop.Customer", ("c_custkey",), excluded=frozenset({"c_nationkey", "c_acctbal"}))
_J = "coalesce('\"' || {0} || '\"', 'null')"


def _captured(spark: SparkSession, d: str, config: cp.EntityConfig = _PLAIN) -> DataFrame:
    return cp.capture(*derived.customer_images(spark, d), config)


_register(
    "capture_flat",
    lambda spark, d: _captured(spark, d).select("entity_type", "entity_id", "action", "diff", "snapshot"),
    f"""WITH {derived.CUSTOMER_IMAGES_SQL}
 SELECT 'shop.Customer' AS entity_type, CAST(coalesce(b.c_custkey, a.c_custkey) AS VARCHAR) AS entity_id,
  CAST(CASE WHEN b.c_custkey IS NULL THEN 0 WHEN a.c_custkey IS NULL THEN 2 ELSE 1 END AS INTEGER) AS action,
  CASE WHEN b.c_custkey IS NULL THEN '[{{"op":"add","path":"/c_name","value":' || {_J.format("a.c_name")} || '}},{{"op":"add","path":"/c_mktsegment","value":' || {_J.format("a.c_mktsegment")} || '}}]'
   WHEN a.c_custkey IS NULL THEN '[{{"op":"remove","path":"/c_name"}},{{"op":"remove","path":"/c_mktsegment"}}]'
   ELSE '[' || concat_ws(',', CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN '{{"op":"replace","path":"/c_name","value":' || {_J.format("a.c_name")} || '}}' END,
     CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN '{{"op":"replace","path":"/c_mktsegment","value":' || {_J.format("a.c_mktsegment")} || '}}' END) || ']' END AS diff,
  CASE WHEN a.c_custkey IS NULL THEN '{{"c_name":' || {_J.format("b.c_name")} || ',"c_mktsegment":' || {_J.format("b.c_mktsegment")} || '}}' END AS snapshot
 FROM before_ b FULL JOIN after_ a ON a.c_custkey = b.c_custkey
 WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""",
)
_HASHED, _BALANCE = """coalesce('"' || sha256({0}.c_name) || '"', 'null')""", "coalesce(CAST({0}.c_acctbal AS VARCHAR), 'null')"
_register(
    "capture_ruled",
    lambda spark, d: _captured(spark, d, CUSTOMER).select("entity_id", "action", "diff", "after_json"),
    f"""WITH {derived.CUSTOMER_IMAGES_SQL}
 SELECT CAST(coalesce(b.c_custkey, a.c_custkey) AS VARCHAR) AS entity_id, CAST(CASE WHEN b.c_custkey IS NULL THEN 0 WHEN a.c_custkey IS NULL THEN 2 ELSE 1 END AS INTEGER) AS action,
  CASE WHEN b.c_custkey IS NULL THEN '[{{"op":"add","path":"/c_name","value":' || {_HASHED.format("a")} || '}},{{"op":"add","path":"/c_acctbal","value":' || {_BALANCE.format("a")} || '}},{{"op":"add","path":"/c_mktsegment","value":"<redacted>"}}]'
   WHEN a.c_custkey IS NULL THEN '[{{"op":"remove","path":"/c_name"}},{{"op":"remove","path":"/c_acctbal"}},{{"op":"remove","path":"/c_mktsegment"}}]'
   WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN '[{{"op":"replace","path":"/c_acctbal","value":' || {_BALANCE.format("a")} || '}}]' ELSE '[]' END AS diff,
  CASE WHEN a.c_custkey IS NOT NULL THEN '{{"c_name":' || {_HASHED.format("a")} || ',"c_acctbal":' || {_BALANCE.format("a")} || ',"c_mktsegment":"<redacted>"}}' END AS after_json
 FROM before_ b FULL JOIN after_ a ON a.c_custkey = b.c_custkey
 WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""",
)
_SOFT = cp.EntityConfig("shop.Customer", ("c_custkey",), soft_delete="gone")
_register(
    "soft_delete_actions",
    lambda spark, d: cp.capture(*[x.withColumn("gone", F.lit(k == 1) & (F.col("c_custkey") % 5 == 0)) for k, x in enumerate(derived.customer_images(spark, d))], _SOFT).groupBy("action").agg(F.count("*").alias("n")),
    f"""WITH {derived.CUSTOMER_IMAGES_SQL} SELECT CAST(CASE WHEN b.c_custkey IS NULL THEN 0 WHEN a.c_custkey IS NULL THEN 2 WHEN a.c_custkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS action, count(*) AS n
 FROM before_ b FULL JOIN after_ a ON a.c_custkey = b.c_custkey
 WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_custkey % 5 = 0 OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment GROUP BY 1""",
)

# replay
_STREAMS = "entity_type, entity_id, coalesce(tenant_id, '') AS tenant"
_UNTIL = f"u AS (SELECT *, coalesce(tenant_id, '') AS tenant FROM audit_log WHERE occurred_on_utc <= TIMESTAMP '{_AS_OF}')"
_LAST = """, ops AS (SELECT entity_type, entity_id, tenant, occurred_on_utc, id, unnest(json_extract(diff, '$[*]')) AS o, generate_subscripts(json_extract(diff, '$[*]'), 1) AS place FROM u),
 last_op AS (SELECT entity_type, entity_id, tenant, json_extract_string(o, '$.path') AS path, CAST(json_extract(o, '$.value') AS VARCHAR) AS value FROM ops
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, tenant, json_extract_string(o, '$.path') ORDER BY occurred_on_utc DESC, id DESC, place DESC) = 1),
 alive AS (SELECT entity_type, entity_id, tenant FROM u QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY occurred_on_utc DESC, id DESC) = 1 AND action NOT IN (2, 3))"""
on_log("replay_flat", lambda df: replay.reconstruct_flat(df, _AS_OF), f", {_UNTIL}{_LAST} SELECT l.* FROM last_op l SEMI JOIN alive a USING (entity_type, entity_id, tenant)")
_FIELD = "max(value) FILTER (path = '/{0}')"
_STATE = f"""SELECT e.entity_type, e.entity_id, e.tenant, {_FIELD.format("value")} AS value, {_FIELD.format("city")} AS city, {_FIELD.format("valueCode")} AS value_code
 FROM (SELECT DISTINCT entity_type, entity_id, tenant FROM u) e LEFT JOIN (SELECT l.* FROM last_op l SEMI JOIN alive a USING (entity_type, entity_id, tenant)) s USING (entity_type, entity_id, tenant) GROUP BY 1, 2, 3"""
# the flat paths end at the same values as the fold
on_log("replay_fold", lambda df: replay.reconstruct(df, _AS_OF).select(*STREAM, *[F.get_json_object("state", f"$.{p}").alias(n) for p, n in (("value", "value"), ("city", "city"), ("valueCode", "value_code"))]), f", {_UNTIL}{_LAST} {_STATE}".replace("AS city,", "AS city,").replace("max(value) FILTER (path = '/city')", "max(trim(value, '\"')) FILTER (path = '/city')"))
on_log("replay_many_states", lambda df: replay.reconstruct_many(df, df.select("entity_id").distinct(), "shop.Order", _AS_OF).select("entity_id", "tenant", *[F.get_json_object("state", f"$.{p}").alias(n) for p, n in (("value", "value"), ("city", "city"), ("valueCode", "value_code"))], F.col("state").isNotNull().alias("alive")),
       f""", u AS (SELECT *, coalesce(tenant_id, '') AS tenant FROM audit_log WHERE entity_type = 'shop.Order' AND occurred_on_utc <= TIMESTAMP '{_AS_OF}'){_LAST},
 st AS ({_STATE}), ids AS (SELECT DISTINCT entity_id FROM audit_log) SELECT i.entity_id, st.tenant, value, trim(city, '"') AS city, value_code, a.entity_id IS NOT NULL AS alive FROM ids i LEFT JOIN st ON st.entity_id = i.entity_id LEFT JOIN alive a ON a.entity_id = st.entity_id AND a.tenant = st.tenant""")
on_log("replay_many", lambda df: replay.reconstruct_many(df.where("tenant_id = 't1'"), df.sparkSession.range(0, 60).select(F.col("id").cast("string").alias("entity_id")), "shop.Order", _AS_OF).select("entity_id", F.col("state").isNotNull().alias("alive")),
       f""", u AS (SELECT * FROM audit_log WHERE tenant_id = 't1' AND entity_type = 'shop.Order' AND occurred_on_utc <= TIMESTAMP '{_AS_OF}'),
 last_ AS (SELECT entity_id, action FROM u QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY occurred_on_utc DESC, id DESC) = 1)
 SELECT CAST(r AS VARCHAR) AS entity_id, coalesce(action NOT IN (2, 3), false) AS alive FROM range(0, 60) t(r) LEFT JOIN last_ ON entity_id = CAST(r AS VARCHAR)""")  # fmt: skip
on_log("is_flat", replay.is_flat, "SELECT true AS flat")
on_log("snapshot_every_n", lambda df: cp.snapshot_every(df, 5).select("id", "snapshot_due"), "SELECT id, action = 1 AND sum(CASE WHEN action = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id ROWS UNBOUNDED PRECEDING) % 5 = 0 AS snapshot_due FROM audit_log")
on_log("snapshot_every_duration", lambda df: cp.snapshot_every_duration(df, 86_400).select("id", "snapshot_due"), """, c AS (SELECT entity_type, entity_id, coalesce(tenant_id, '') AS tenant, id, occurred_on_utc AS t, row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k FROM audit_log WHERE action = 1),
 walked AS (WITH RECURSIVE w AS (SELECT *, t AS last_, true AS due FROM c WHERE k = 1 UNION ALL
   SELECT c.*, CASE WHEN c.t >= w.last_ + INTERVAL 1 DAY THEN c.t ELSE w.last_ END, c.t >= w.last_ + INTERVAL 1 DAY FROM w JOIN c ON c.entity_type = w.entity_type AND c.entity_id = w.entity_id AND c.tenant = w.tenant AND c.k = w.k + 1) SELECT * FROM w)
 SELECT a.id, coalesce(w.due, false) AS snapshot_due FROM audit_log a LEFT JOIN walked w ON a.id = w.id""")  # fmt: skip

# compaction and retention
_FOLD = """SELECT id, CASE WHEN n < 2 OR k > n THEN 'keep' WHEN k = n THEN 'boundary' ELSE 'remove' END AS fold FROM (SELECT id,
 row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k,
 count(*) OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '')) - 10 AS n FROM audit_log)"""
on_log("compaction_rows", lambda df: compaction.ranked(df, 10).select("id", "fold"), _FOLD)
on_log("compaction_summary", lambda df: compaction.summary(df, 10).select(*STREAM, "rows_before", "rows_removed", "rows_after", "snapshot_written"), """SELECT entity_type, entity_id, coalesce(tenant_id, '') AS tenant, count(*) AS rows_before,
 greatest(CASE WHEN count(*) - 10 < 2 THEN 0 ELSE count(*) - 11 END, 0) AS rows_removed, count(*) - greatest(CASE WHEN count(*) - 10 < 2 THEN 0 ELSE count(*) - 11 END, 0) AS rows_after, count(*) - 10 >= 2 AS snapshot_written FROM audit_log GROUP BY 1, 2, 3""")  # fmt: skip
on_log("compacted_log", lambda df: compaction.compact(df, 10).select("id", "action", "diff", F.get_json_object("snapshot", "$.value").alias("snapshot_value")), f""", fold AS ({_FOLD}),
 ops AS (SELECT a.*, fold.fold, coalesce(tenant_id, '') AS tenant, json_extract_string(diff, '$[0].value') AS v FROM audit_log a JOIN fold USING (id))
 SELECT id, CAST(CASE WHEN fold = 'boundary' AND action NOT IN (2, 3) THEN 0 ELSE action END AS INTEGER) AS action, CASE WHEN fold = 'boundary' THEN '[]' ELSE diff END AS diff, CASE WHEN fold = 'boundary' THEN v END AS snapshot_value FROM ops WHERE fold <> 'remove'""")  # fmt: skip
on_log("compacted_states", lambda df: compaction.compact(df, 10).where("diff = '[]'").select("id", "snapshot"), f""", s AS (SELECT *, coalesce(tenant_id, '') AS tenant FROM audit_log), fold AS ({_FOLD}),
 ops AS (SELECT entity_type, entity_id, tenant, occurred_on_utc, s.id, fold.fold, unnest(json_extract(diff, '$[*]')) AS o, generate_subscripts(json_extract(diff, '$[*]'), 1) AS place FROM s JOIN fold ON fold.id = s.id WHERE fold.fold <> 'keep'),
 p AS (SELECT *, json_extract_string(o, '$.path') AS path, CAST(json_extract(o, '$.value') AS VARCHAR) AS value FROM ops),
 last_ AS (SELECT entity_type, entity_id, tenant, path, arg_max(value, (occurred_on_utc, id, place)) AS value, min((occurred_on_utc, id, place)) AS first_ FROM p GROUP BY 1, 2, 3, 4),
 docs AS (SELECT entity_type, entity_id, tenant, '{{' || string_agg('"' || substr(path, 2) || '":' || value, ',' ORDER BY first_) || '}}' AS snapshot FROM last_ GROUP BY 1, 2, 3)
 SELECT s.id, docs.snapshot FROM s JOIN fold ON fold.id = s.id JOIN docs ON docs.entity_type = s.entity_type AND docs.entity_id = s.entity_id AND docs.tenant = s.tenant WHERE fold.fold = 'boundary'""")  # fmt: skip
on_log("retain_for", lambda df: retention.expired(df, retention.RetainFor(dt.timedelta(days=20)), NOW, None).select("id"), "SELECT id FROM audit_log WHERE occurred_on_utc < TIMESTAMP '2024-01-11'")
on_log("retain_for_budget", lambda df: retention.expired(df, retention.RetainFor(dt.timedelta(days=20)), NOW, 300).select("id"), "SELECT id FROM audit_log WHERE occurred_on_utc < TIMESTAMP '2024-01-11' ORDER BY occurred_on_utc, id LIMIT 300")
_PLACE = "row_number() OVER (PARTITION BY entity_type, entity_id, tenant_id ORDER BY occurred_on_utc DESC, id DESC)"
on_log("retain_count", lambda df: retention.expired(df, retention.RetainCount(8), NOW, None).select("id"), f"SELECT id FROM audit_log QUALIFY {_PLACE} > 8")
_NESTED = retention.PerTenant({"t1": retention.RetainCount(4), "t2": retention.PerEntityType({"shop.Order": retention.RetainFor(dt.timedelta(days=3))}, retention.RetainCount(6))}, retention.RetainFor(dt.timedelta(days=25)))
on_log("retention_per_tenant", lambda df: retention.expired(df, _NESTED, NOW, None).select("id"), f"""SELECT id FROM (SELECT *, {_PLACE} AS k FROM audit_log) WHERE CASE WHEN tenant_id = 't1' THEN k > 4
 WHEN tenant_id = 't2' AND entity_type = 'shop.Order' THEN occurred_on_utc < TIMESTAMP '2024-01-28' WHEN tenant_id = 't2' THEN k > 6 ELSE occurred_on_utc < TIMESTAMP '2024-01-06' END""")  # fmt: skip
_BY_TYPE = retention.PerEntityType({"shop.Order": retention.RetainCount(3), "shop.Incident": retention.RetainFor(dt.timedelta(days=10))})
on_log("retention_per_type", lambda df: retention.expired(df, _BY_TYPE, NOW, None).select("id"), f"SELECT id FROM (SELECT *, {_PLACE} AS k FROM audit_log) WHERE (entity_type = 'shop.Order' AND k > 3) OR (entity_type = 'shop.Incident' AND occurred_on_utc < TIMESTAMP '2024-01-21')")
on_log("retain_count_budget", lambda df: retention.expired(df, retention.RetainCount(8), NOW, 500).select("id"), f"""SELECT id FROM (SELECT id, k, total, sum(CASE WHEN k > 8 THEN 1 ELSE 0 END) OVER (ORDER BY entity_type, entity_id, tenant_id NULLS FIRST, k ROWS UNBOUNDED PRECEDING) AS taken
 FROM (SELECT *, {_PLACE} AS k, 1 AS total FROM audit_log)) WHERE k > 8 AND taken <= 500""")
on_log("retention_survivors", lambda df: retention.survivors(df, retention.expired(df, retention.RetainCount(8), NOW, None)).select("id"), f"SELECT id FROM audit_log QUALIFY {_PLACE} <= 8")

# integrity
_FIELDS = ("id", "entity_type", "entity_base_type", "entity_id", "CAST(action AS VARCHAR)", "CAST(epoch_us(occurred_on_utc) // 1000 AS VARCHAR)", "user_id", "user_display", "user_type", "tenant_id", "correlation_id", "diff", "snapshot", "error", "'1'", "'note'", "user_type", "CAST(NULL AS VARCHAR)")
_CANON = " || ".join(f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-1:')" for x in _FIELDS)
on_log("canonical_string", lambda df: df.select("id", cn.canonical(F.lit(None), {"note": F.col("user_type")}).alias("canonical")), f"SELECT id, {_CANON} AS canonical FROM audit_log")
_IPAD, _OPAD = ("".join(f"{b ^ p:02x}" for b in KEY.ljust(64, b"\0")) for p in (0x36, 0x5C))
on_log("entry_hash", lambda df: df.select("id", cn.hmac_sha256(KEY, cn.canonical(F.lit(None), {"note": F.col("user_type")})).alias("entry_hash")), f"SELECT id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({_CANON})))) AS entry_hash FROM audit_log")


def _chained(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log stamped in two batches under two keys, and its anchors."""
    early = F.col("occurred_on_utc") < F.lit("2024-01-15T00:00:00").cast("timestamp_ntz")
    none = integrity.no_anchors(df)
    first = stored(integrity.stamp(df.where(early), none, 1, KEY))
    anchors = stored(integrity.advanced_anchors(none, first))
    second = stored(integrity.stamp(df.where(~early), anchors, 2, KEY[::-1]))
    return first.unionByName(second), stored(integrity.advanced_anchors(anchors, second))


KEYS = {1: KEY, 2: KEY[::-1]}
on_log("stamp_chain", lambda df: _chained(df)[0].select("id", "hash_key_id", "chain_sequence", F.col("previous_hash").isNull().alias("first")), """SELECT id, CAST(CASE WHEN occurred_on_utc < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS INTEGER) AS hash_key_id,
 k AS chain_sequence, k = 1 AS first FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k FROM audit_log)""")  # fmt: skip
on_log("chain_anchors", lambda df: _chained(df)[1].select(*STREAM, "row_count", "pruned_row_count"), "SELECT entity_type, entity_id, coalesce(tenant_id, '') AS tenant, count(*) AS row_count, CAST(0 AS BIGINT) AS pruned_row_count FROM audit_log GROUP BY 1, 2, 3")


def _tampered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chained, then a user changed in every 400th row and every 300th row gone."""
    log, anchors = _chained(df)
    n = F.substring("id", 25, 12).cast("long")
    return log.where(n % 300 != 0).withColumn("user_id", F.when(n % 400 == 0, "mallory").otherwise(F.col("user_id"))), anchors


_NUMBERED = """, s AS (SELECT *, coalesce(tenant_id, '') AS tenant, CAST(substr(id, 25) AS BIGINT) AS n FROM audit_log), k AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY occurred_on_utc, id) AS seq, count(*) OVER (PARTITION BY entity_type, entity_id, tenant) AS total FROM s),
 kept AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY seq), 0) AS before_, row_number() OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY seq) AS walk FROM k WHERE n % 300 <> 0),
 bad AS (SELECT *, CASE WHEN before_ <> seq - 1 THEN 'BrokenLink' WHEN n % 400 = 0 THEN 'ContentMismatch' END AS reason FROM kept),
 per AS (SELECT entity_type, entity_id, tenant, min(walk) FILTER (reason IS NOT NULL) AS first_bad, min_by(reason, walk) FILTER (reason IS NOT NULL) AS reason, count(*) AS n_rows, max(seq) AS last_ FROM bad GROUP BY 1, 2, 3),
 every AS (SELECT DISTINCT entity_type, entity_id, tenant, total FROM k),
 res AS (SELECT entity_type, entity_id, tenant, CASE WHEN first_bad IS NOT NULL THEN first_bad - 1 ELSE coalesce(n_rows, 0) END AS verified,
  coalesce(reason, CASE WHEN coalesce(n_rows, 0) <> total THEN 'Truncated' END) AS reason FROM every LEFT JOIN per USING (entity_type, entity_id, tenant))"""
on_log("verify_streams", lambda df: integrity.verify_streams(*_tampered(df), KEYS).select(*STREAM, "verified", "reason"), f"{_NUMBERED} SELECT * FROM res")
on_log("verify_chain", lambda df: integrity.verify_chain(*_tampered(df), KEYS).select("is_valid", "verified", "reason"), f"""{_NUMBERED}, first_ AS (SELECT * FROM res WHERE reason IS NOT NULL ORDER BY entity_type, entity_id, tenant LIMIT 1)
 SELECT false AS is_valid, CAST(sum(verified) AS BIGINT) AS verified, (SELECT reason FROM first_) AS reason FROM res WHERE (entity_type, entity_id, tenant) <= (SELECT (entity_type, entity_id, tenant) FROM first_)""")  # fmt: skip
on_log("verify_intact", lambda df: integrity.verify_chain(*_chained(df), KEYS).select("is_valid", "verified", "reason"), "SELECT true AS is_valid, count(*) AS verified, 'None' AS reason FROM audit_log")
on_log("walk_order", lambda df: integrity.walk_order(df.withColumn("chain_sequence", F.when(F.substring("id", 34, 3).cast("int") % 3 != 0, F.row_number().over(_by_id())))).select("id", "walk"), """, q AS (SELECT *, coalesce(tenant_id, '') AS tenant, CASE WHEN CAST(substr(id, 34, 3) AS INTEGER) % 3 <> 0 THEN row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY id) END AS seq FROM audit_log),
 r AS (SELECT *, CASE WHEN seq IS NULL THEN occurred_on_utc ELSE max(occurred_on_utc) FILTER (seq IS NOT NULL) OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY seq NULLS LAST, id ROWS UNBOUNDED PRECEDING) END AS reached FROM q)
 SELECT id, CAST(row_number() OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY reached, seq IS NULL, seq, occurred_on_utc, id) AS INTEGER) AS walk FROM r""")  # fmt: skip


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("entity_type", "entity_id", tenant()).orderBy("id")


def _pruned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    log, anchors = _chained(df)
    due = (F.col("occurred_on_utc") < F.lit("2024-01-11T00:00:00").cast("timestamp_ntz")) & (F.substring("id", 25, 12).cast("long") % 10 != 0)
    return integrity.prunable(log.where(due), anchors), anchors


_HEADS = """, s AS (SELECT *, coalesce(tenant_id, '') AS tenant, row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k FROM audit_log),
 d AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, tenant ORDER BY k) AS j FROM s WHERE occurred_on_utc < TIMESTAMP '2024-01-11' AND CAST(substr(id, 25) AS BIGINT) % 10 <> 0)"""
on_log("prune_heads", lambda df: _pruned(df)[0].select("id"), f"{_HEADS} SELECT id FROM d WHERE j = k")
on_log("pruned_anchors", lambda df: (lambda r, a: integrity.pruned_anchors(a, r).select(*STREAM, "row_count", "pruned_row_count"))(*_pruned(df)), f"{_HEADS} SELECT entity_type, entity_id, tenant, count(*) AS row_count, (SELECT count(*) FROM d WHERE d.j = d.k AND d.entity_type = s.entity_type AND d.entity_id = s.entity_id AND d.tenant = s.tenant) AS pruned_row_count FROM s GROUP BY 1, 2, 3")
on_log("all_streams", lambda df: ag.all_streams(df.where("tenant_id = 't1'"), df.where("user_type = 'job'").select("entity_type", "entity_id", tenant().alias("tenant")).distinct()), f"SELECT {_STREAMS} FROM audit_log WHERE tenant_id = 't1' UNION SELECT {_STREAMS} FROM audit_log WHERE user_type = 'job'")
on_log("batch_summary", lambda df: ag.batch_summary(df).drop("last_hash"), f"SELECT {_STREAMS}, max_by(id, occurred_on_utc) AS last_id, count(*) AS added FROM audit_log GROUP BY 1, 2, 3")


# import and export
def _imported(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.substring("id", 25, 12).cast("long")
    records = df.select("id", "entity_type", "entity_id", "action", "occurred_on_utc", "user_id", "tenant_id", F.when(n % 4 != 0, n.cast("string")).alias("source_id"), F.when(n % 10 != 0, '{"a":1,"b":[1,2]}').otherwise("{broken").alias("before_json"), F.lit('{"a":2,"b":[1,3,4],"c":{"d":null}}').alias("after_json"))
    existing = df.where(n % 3 == 0).select(F.concat(F.lit("import:legacy#"), n.cast("string")).alias("correlation_id"))
    return records, importer.imported(records, existing, "legacy")


# nested documents, different for each order: properties that go, come, change and change their kind, arrays that grow and shrink
_DOCUMENT = {
    "before": """concat('{"status":"', o_orderstatus, '","gone":', k, ',"items":[', array_join(slice(array(0, 10, 20, 30, 40), 1, cast(k % 5 as int)), ','), '],"meta":{"a~/b":', k % 3, ',"in":{"c":"x","d":[true,{"e":', k, '}]}},"swap":1,"frac":1.50}')""",
    "after": """concat('{"meta":{"a~/b":', (k + k % 2) % 3, ',"in":{"c":"', if(k % 4 = 0, 'y', 'x'), '","d":[true,{"e":', k - k % 6, '}]}},"status":"', o_orderstatus, '","items":[', array_join(slice(array(0, 11, 20, 31, 40), 1, cast(k % 3 as int)), ','), '],"swap":', if(k % 7 = 0, '{"k":[]}', '1'), ',"frac":', if(k % 8 = 0, '2.50', '1.5'), ',"new":null}')""",
}
_register(
    "diff_nested",
    lambda spark, d: derived.table(spark, d, "orders").withColumn("k", F.col("o_orderkey")).select("k", importer.nested_diff(*[F.expr(_DOCUMENT[c]) for c in ("before", "after")]).alias("d")).select(F.col("k").cast("long").alias("k"), "d.diff", "d.error"),
    """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), p AS (SELECT k, k % 5 AS nb, k % 3 AS na FROM o),
 r AS (SELECT *, '{"op":"replace","path":"' AS rep FROM p)
 SELECT k, '[' || concat_ws(',', '{"op":"remove","path":"/gone"}', CASE WHEN (k + k % 2) % 3 <> k % 3 THEN rep || '/meta/a~0~1b","value":' || ((k + k % 2) % 3) || '}' END, CASE WHEN k % 4 = 0 THEN rep || '/meta/in/c","value":"y"}' END,
  CASE WHEN k % 6 <> 0 THEN rep || '/meta/in/d/1/e","value":' || (k - k % 6) || '}' END, CASE WHEN nb > 1 AND na > 1 THEN rep || '/items/1","value":11}' END,
  CASE WHEN na > nb THEN array_to_string(list_transform(range(nb, na), lambda i: '{"op":"add","path":"/items/' || i || '","value":' || [0, 11, 20, 31, 40][i + 1] || '}'), ',') END,
  CASE WHEN nb > na THEN array_to_string(list_transform(list_reverse(range(na, nb)), lambda i: '{"op":"remove","path":"/items/' || i || '"}'), ',') END,
  CASE WHEN k % 7 = 0 THEN rep || '/swap","value":{"k":[]}}' END, CASE WHEN k % 8 = 0 THEN rep || '/frac","value":2.50}' END, '{"op":"add","path":"/new","value":null}') || ']' AS diff, CAST(NULL AS VARCHAR) AS error FROM r""",
)

_TAKEN = ", s AS (SELECT *, CAST(substr(id, 25) AS BIGINT) AS n FROM audit_log), t AS (SELECT * FROM s WHERE n % 4 = 0 OR n % 3 <> 0)"
on_log("import_dedupe", lambda df: _imported(df)[1].select("id", "correlation_id", "diff", F.col("error").isNotNull().alias("failed")), f"""{_TAKEN} SELECT id, 'import:legacy' || CASE WHEN n % 4 <> 0 THEN '#' || CAST(n AS VARCHAR) ELSE '' END AS correlation_id,
 CASE WHEN n % 10 = 0 THEN '[]' ELSE '[{{"op":"replace","path":"/a","value":2}},{{"op":"replace","path":"/b/1","value":3}},{{"op":"add","path":"/b/2","value":4}},{{"op":"add","path":"/c","value":{{"d":null}}}}]' END AS diff, n % 10 = 0 AS failed FROM t""")  # fmt: skip
on_log("import_batch_prefix", lambda df: f.import_batch("legacy")(_imported(df)[1].unionByName(df)).select("id", "correlation_id"), f"{_TAKEN} SELECT id, 'import:legacy' || CASE WHEN n % 4 <> 0 THEN '#' || CAST(n AS VARCHAR) ELSE '' END AS correlation_id FROM t")
on_log("import_result", lambda df: (lambda records, rows: importer.result(records, stored(rows)))(*_imported(df)), f"{_TAKEN} SELECT count(*) FILTER (n % 10 <> 0) AS written, (SELECT count(*) FROM s) - count(*) AS skipped, count(*) FILTER (n % 10 = 0) AS dead_lettered FROM t")
_S = "coalesce('\"' || {0} || '\"', 'null')"
on_log("ndjson_text", lambda df: export.ndjson(df).select("id", "line"), f"""SELECT id, '{{"id":"' || id || '","entityType":"' || entity_type || '","entityBaseType":' || {_S.format("entity_base_type")} || ',"entityId":"' || entity_id || '","action":"' || {_NAMES}
 || '","occurredOnUtc":"' || strftime(occurred_on_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","userId":' || {_S.format("user_id")} || ',"userDisplay":null,"userType":"' || user_type || '","tenantId":' || {_S.format("tenant_id")} || ',"correlationId":"' || correlation_id
 || '","diff":' || diff || ',"snapshot":null,"error":null,"entryHash":null,"previousHash":null,"hashKeyId":null}}' AS line FROM audit_log""")  # fmt: skip


# streaming
def _queue(spark: SparkSession, d: str, at: str, attempts: int = 4) -> None:
    """Customer changes as queue entries; the images of every 11th can't be read."""
    from ..streaming.dispatch import enqueue

    rows = _captured(spark, d, CUSTOMER)
    broken = F.col("entity_id").cast("long") % 11 == 0
    entries = rows.select(
        F.concat(F.lit("q-"), "entity_id").alias("id"), "entity_type", "entity_base_type", "entity_id", "action", F.when(broken, "{").otherwise(F.col("before_json")).alias("before_json"), "after_json",
        F.lit("2024-01-30T00:00:00").cast("timestamp_ntz").alias("occurred_on_utc"), F.lit("u1").alias("user_id"), F.lit(None).cast("string").alias("user_display"), F.lit("job").alias("user_type"),
        F.lit("t1").alias("tenant_id"), F.lit("corr").alias("correlation_id"), F.lit(attempts).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit('{"region":"eu","unknown":1}').alias("custom_columns_json"),
    ).repartition(3)
    enqueue(entries, at, "capture")


def _dispatched(spark: SparkSession, d: str):
    from ..streaming.dispatch import Dispatcher

    at = folder(spark)
    _queue(spark, d, f"{at}/queue")
    run = Dispatcher(spark, f"{at}/queue", f"{at}/out", custom_schema="region string", max_files=2)
    run.flush()
    return run


_ENTITIES = f"""WITH {derived.CUSTOMER_IMAGES_SQL}, q AS (SELECT coalesce(b.c_custkey, a.c_custkey) AS k, CAST(CASE WHEN b.c_custkey IS NULL THEN 0 WHEN a.c_custkey IS NULL THEN 2 ELSE 1 END AS INTEGER) AS action FROM before_ b FULL JOIN after_ a ON a.c_custkey = b.c_custkey
 WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment)"""
_register("stream_dispatch", lambda spark, d: _dispatched(spark, d).log().select("id", "action", "region"), f"{_ENTITIES} SELECT 'q-' || CAST(k AS VARCHAR) AS id, action, 'eu' AS region FROM q WHERE k % 11 <> 0")
_register("stream_dead_letters", lambda spark, d: _dispatched(spark, d).dead().select("id", "attempts", F.col("error").isNotNull().alias("told")), f"{_ENTITIES} SELECT 'q-' || CAST(k AS VARCHAR) AS id, CAST(5 AS INTEGER) AS attempts, true AS told FROM q WHERE k % 11 = 0")


def _lag(df: DataFrame) -> DataFrame:
    from ..streaming.dispatch import lag

    return lag(df, "2024-01-20T00:00:00", 86_400)


on_log("dispatch_lag", _lag, "SELECT id, greatest(0, date_diff('microsecond', occurred_on_utc, TIMESTAMP '2024-01-20') // 1000000) AS lag_seconds, date_diff('microsecond', occurred_on_utc, TIMESTAMP '2024-01-20') // 1000000 > 86400 AS late FROM audit_log")


def _cadence(spark: SparkSession, d: str) -> DataFrame:
    """The whole log in four ranges of time, each of them micro-batches of their own."""
    from ..streaming.cadence import Every, snapshot_cadence

    at, log = folder(spark), derived.audit_log(spark, d)
    for k in range(4):
        days = F.dayofmonth("occurred_on_utc") - 1
        log.where(F.least(F.floor(days / 8), F.lit(3)) == k).repartition(2, "id").write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/log")
    snapshot_cadence(stream, Every(4), f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out/due").select("id", "snapshot_due")


_register("stream_snapshot_cadence", _cadence, f"WITH {derived.AUDIT_LOG_SQL} SELECT id, action = 1 AND sum(CASE WHEN action = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id ROWS UNBOUNDED PRECEDING) % 4 = 0 AS snapshot_due FROM audit_log")


def _retried(spark: SparkSession, d: str, snapshots: bool = False):
    """Entries from no attempt on: the broken ones go back to the queue until they are given up."""
    from ..streaming.cadence import Every
    from ..streaming.dispatch import Dispatcher

    at = folder(spark)
    _queue(spark, d, f"{at}/queue", attempts=0)
    run = Dispatcher(spark, f"{at}/queue", f"{at}/out", custom_schema="region string", max_files=2, policy=Every(1) if snapshots else None)
    run.flush()
    while run.redeliver():
        run.flush()
    return run


_register("stream_retry", lambda spark, d: (lambda run: run.log().select("id", F.lit(0).alias("attempts"), F.lit(False).alias("given_up")).unionByName(run.dead().select("id", "attempts", F.lit(True).alias("given_up"))))(_retried(spark, d)),
          f"{_ENTITIES} SELECT 'q-' || CAST(k AS VARCHAR) AS id, CAST(CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS INTEGER) AS attempts, k % 11 = 0 AS given_up FROM q")
_register("stream_snapshots", lambda spark, d: _retried(spark, d, snapshots=True).log().select("id", "action", F.get_json_object("snapshot", "$.c_mktsegment").alias("segment"), F.col("snapshot").isNotNull().alias("kept")),
          f"{_ENTITIES} SELECT 'q-' || CAST(k AS VARCHAR) AS id, action, CASE WHEN action > 0 THEN '<redacted>' END AS segment, action > 0 AS kept FROM q WHERE k % 11 <> 0")


def _log_queue(spark: SparkSession, d: str, at: str, batches: int = 6) -> None:
    """The log's rows as queue entries, two files for each range of time."""
    from ..streaming.dispatch import enqueue

    log = derived.audit_log(spark, d)
    n, days = F.substring("id", 25, 12).cast("long"), F.dayofmonth("occurred_on_utc") - 1
    image = lambda k: F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}"))
    rows = log.withColumns({"before_json": image(n - 1), "after_json": image(n), "attempts": F.lit(0), "custom_columns_json": F.concat(F.lit('{"region":"r'), (n % 5).cast("string"), F.lit('"}'))})
    for k in range(batches):
        enqueue(rows.where(F.least(F.floor(days / 5), F.lit(batches - 1)) == k).repartition(2, "id"), at, f"range{k}")


def _log_dispatched(spark: SparkSession, d: str, **options):
    from ..streaming.dispatch import Dispatcher

    at = folder(spark)
    _log_queue(spark, d, f"{at}/queue")
    run = Dispatcher(spark, f"{at}/queue", f"{at}/out", max_files=2, custom_schema="region string", **options)
    run.flush()
    return run


def _cadenced(spark: SparkSession, d: str, policy: str) -> DataFrame:
    from ..streaming import cadence

    run = _log_dispatched(spark, d, policy={"n": cadence.Every(3), "duration": cadence.EveryDuration(dt.timedelta(days=1))}[policy])
    return run.log().select("id", "action", "snapshot")


_IMAGES = "'{{\"n\":' || CAST(CAST(substr(a.id, 25) AS BIGINT) - {} AS VARCHAR) || '}}'"
_KEPT = f"SELECT a.id, a.action, CASE WHEN a.action = 2 THEN {_IMAGES.format(1)} WHEN a.action = 3 OR due.snapshot_due THEN {_IMAGES.format(0)} END AS snapshot FROM audit_log a JOIN due USING (id)"
for _name, _by in (("n", "snapshot_every_n"), ("duration", "snapshot_every_duration")):
    _due = SQL[_by].split(f"WITH {derived.AUDIT_LOG_SQL}", 1)[1].replace("% 5 = 0", "% 3 = 0")
    _with, _select = ("", _due) if not _due.lstrip().startswith(",") else (_due[: _due.rindex("SELECT a.id")], _due[_due.rindex("SELECT a.id") :])
    _register(f"stream_cadence_{_name}", lambda spark, d, p=_name: _cadenced(spark, d, p), f"WITH {derived.AUDIT_LOG_SQL} {_with}, due AS ({_select}) {_KEPT}")


def _policy_snapshots(df: DataFrame, policy: cp.Policy) -> DataFrame:
    image = F.concat(F.lit('{"n":'), F.substring("id", 25, 12).cast("long").cast("string"), F.lit("}"))
    return cp.policy_snapshots(df.withColumn("after_json", image), policy).select("id", "snapshot")


for _name, _policy in (("n", cp.Every(3)), ("duration", cp.EveryDuration(dt.timedelta(days=1)))):
    on_log(f"policy_snapshots_{_name}", lambda df, p=_policy: _policy_snapshots(df, p), SQL[f"stream_cadence_{_name}"].split(f"WITH {derived.AUDIT_LOG_SQL}", 1)[1].split(" SELECT a.id, a.action")[0] + f" SELECT a.id, CASE WHEN due.snapshot_due THEN {_IMAGES.format(0)} END AS snapshot FROM audit_log a JOIN due USING (id)")


def _stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain that grew over several batches, its custom column covered: as it is, and with that column changed in one row."""
    run = _log_dispatched(spark, d, key=(1, KEY))
    log, anchors = run.log(), stored(run.anchors(5))
    checked = lambda df: integrity.verify_chain(df, anchors, {1: KEY}, custom=cn.custom_texts(df, ["region"])).select("is_valid", "reason")
    changed = log.withColumn("region", F.when(F.col("id").endswith("000000000007"), "elsewhere").otherwise(F.col("region")))
    return checked(log).withColumn("log", F.lit("whole")).unionByName(checked(changed).withColumn("log", F.lit("changed"))).withColumn("anchored", F.lit(anchors.agg(F.sum("row_count")).first()[0]).cast("long"))


_register("stream_chain", _stream_chain, f"WITH {derived.AUDIT_LOG_SQL}, n AS (SELECT count(*) AS n FROM audit_log) SELECT true AS is_valid, 'None' AS reason, 'whole' AS log, n AS anchored FROM n UNION ALL SELECT false, 'ContentMismatch', 'changed', n FROM n")


def _taken(event: dict) -> None:
    """A handler that can't take the events of every 13th customer."""
    if int(event["entity_key"]) % 13 == 0:
        raise ValueError("no such customer here")


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.dispatch import Dispatcher

    at = folder(spark)
    _queue(spark, d, f"{at}/queue")
    run = Dispatcher(spark, f"{at}/queue", f"{at}/out", max_files=2, handler=_taken)
    run.flush()
    while run.outbox.deliver()[1]:
        pass
    return run.outbox.status().select("audit_log_id", "delivered", "attempts", F.col("error").isNotNull().alias("told"))


_register("outbox_delivered", _outbox, f"{_ENTITIES} SELECT 'q-' || CAST(k AS VARCHAR) AS audit_log_id, k % 13 <> 0 AS delivered, CAST(CASE WHEN k % 13 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts, k % 13 = 0 AS told FROM q WHERE k % 11 <> 0")

# records that can't be worked on: they end as errors, and their neighbours don't suffer
_DEEP = '{"a":' * 600 + "1" + "}" * 600


def _poisoned(spark: SparkSession, d: str) -> DataFrame:
    """Entries with images that are too deep, are no objects or hold half a surrogate pair, each at its last attempt."""
    from ..streaming.dispatch import Dispatcher, enqueue

    at, k = folder(spark), F.col("c_custkey")
    after = F.when(k % 5 == 0, _DEEP).when(k % 5 == 1, "[1]").when(k % 5 == 2, '{"s":"\\ud800"}').when(k % 5 == 3, "{").otherwise('{"s":1}')
    entries = derived.table(spark, d, "customer").select(k.cast("string").alias("id"), F.lit("T").alias("entity_type"), k.cast("string").alias("entity_id"), F.lit(0).alias("action"), F.lit(None).cast("string").alias("before_json"), after.alias("after_json"), F.lit("2024-01-01T00:00:00").cast("timestamp_ntz").alias("occurred_on_utc"), F.lit(4).alias("attempts"))
    enqueue(entries, f"{at}/queue", "capture")
    run = Dispatcher(spark, f"{at}/queue", f"{at}/out")
    run.flush()
    return run.log().select("id", "diff", F.lit(False).alias("dead")).unionByName(run.dead().select("id", F.lit(None).cast("string").alias("diff"), F.lit(True).alias("dead")))


_register("stream_poison", _poisoned, """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 5 WHEN 2 THEN '[{"op":"add","path":"/s","value":"\\ud800"}]' WHEN 4 THEN '[{"op":"add","path":"/s","value":1}]' END AS diff, c_custkey % 5 NOT IN (2, 4) AS dead FROM customer""")


def _bad_patches(df: DataFrame) -> DataFrame:
    n = F.substring("id", 25, 12).cast("long")
    bad = F.when(n % 37 == 0, '[{"op":"add","path":5,"value":1}]').when(n % 41 == 0, f'[{{"op":"add","path":"/d","value":{_DEEP}}}]').when(n % 43 == 0, '[{"op":"move","path":"/x"}]').when(n % 47 == 0, '[{"op":7,"path":"/x"}]')
    out = replay.reconstruct(df.withColumn("diff", F.coalesce(bad, F.when(n % 53 == 0, '[{"op":"add","path":"/s","value":"\\udfff"}]'), F.col("diff"))), _AS_OF)
    return out.select(*STREAM, F.col("error").isNotNull().alias("failed"), F.col("state").isNotNull().alias("alive"))


on_log("replay_bad_patches", _bad_patches, f""", {_UNTIL}, s AS (SELECT entity_type, entity_id, tenant, arg_max(action, (occurred_on_utc, id)) NOT IN (2, 3) AS there,
 bool_or(n % 37 = 0 OR n % 41 = 0 OR n % 43 = 0 OR n % 47 = 0) AS bad FROM (SELECT *, CAST(substr(id, 25) AS BIGINT) AS n FROM u) GROUP BY 1, 2, 3)
 SELECT entity_type, entity_id, tenant, there AND bad AS failed, there AND NOT bad AS alive FROM s""")  # fmt: skip

# a log with snapshots: every third row of a stream that isn't its first keeps the state, as the derived patches make it
_WITH_SNAPSHOTS = "s AS (SELECT *, coalesce(tenant_id, '') AS tenant, row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k FROM audit_log)"


def _with_snapshots(df: DataFrame) -> DataFrame:
    """Updates at each third place of a stream keep a snapshot that no patch would make."""
    place = F.row_number().over(Window.partitionBy("entity_type", "entity_id", tenant()).orderBy("occurred_on_utc", "id"))
    kept = (place % 3 == 0) & (F.col("action") == 1)
    return df.withColumn("snapshot", F.when(kept, F.concat(F.lit('{"value":-'), place.cast("string"), F.lit(',"kept":'), place.cast("string"), F.lit("}"))))


on_log("replay_from_snapshot", lambda df: replay.reconstruct(_with_snapshots(df), _AS_OF).select(*STREAM, *[F.get_json_object("state", f"$.{p}").alias(n) for p, n in (("value", "value"), ("kept", "kept"))]),
       f""", {_WITH_SNAPSHOTS}, v AS (SELECT *, k % 3 = 0 AND action = 1 AS snap, json_extract_string(diff, '$[0].value') AS v FROM s WHERE occurred_on_utc <= TIMESTAMP '{_AS_OF}'),
 last_ AS (SELECT entity_type, entity_id, tenant, arg_max(action, k) AS action, arg_max(CASE WHEN snap THEN '-' || CAST(k AS VARCHAR) ELSE v END, k) AS value, CAST(max(k) FILTER (snap) AS VARCHAR) AS kept FROM v GROUP BY 1, 2, 3)
 SELECT entity_type, entity_id, tenant, CASE WHEN action NOT IN (2, 3) THEN value END AS value, CASE WHEN action NOT IN (2, 3) THEN kept END AS kept FROM last_""")  # fmt: skip


def _histogram_sql(rows: str, bounds: tuple) -> str:
    at = " + ".join(f"CASE WHEN v > {b} THEN 1 ELSE 0 END" for b in bounds)
    return f"SELECT CAST({at} AS INTEGER) AS bucket, [{', '.join(f'{float(b)}::DOUBLE' for b in bounds)}][1 + ({at})] AS upper, count(*) AS count, CAST(sum(v) AS BIGINT) AS total FROM ({rows}) GROUP BY 1, 2"


on_log("entry_size_buckets", lambda df: metrics.entry_sizes(_with_snapshots(df)), f""", {_WITH_SNAPSHOTS} {_histogram_sql("SELECT octet_length(encode(diff)) + CASE WHEN k % 3 = 0 AND action = 1 THEN octet_length(encode(concat('{\"value\":-', k, ',\"kept\":', k, '}'))) ELSE 0 END AS v FROM s", metrics.SIZE_BYTES)}""")
on_log("replayed_past_snapshot", lambda df: metrics.replayed_past_snapshot(_with_snapshots(df), _AS_OF), f""", {_WITH_SNAPSHOTS}, l AS (SELECT *, max(CASE WHEN k % 3 = 0 AND action = 1 THEN k END) OVER (PARTITION BY entity_type, entity_id, tenant) AS last_ FROM s WHERE occurred_on_utc <= TIMESTAMP '{_AS_OF}') {_histogram_sql("SELECT count(*) FILTER (last_ IS NULL OR k > last_) AS v FROM l GROUP BY entity_type, entity_id, tenant", metrics.ROWS)}""")
on_log("batch_size_buckets", metrics.batch_sizes, _histogram_sql("SELECT count(*) AS v FROM audit_log GROUP BY correlation_id", metrics.ROWS))


def _swept(df: DataFrame) -> DataFrame:
    """A chained log after a sweep, verified with the anchors that the sweep left."""
    log, anchors = _chained(df)
    at = folder(df.sparkSession)
    taken = retention.sweep(log, retention.RetainFor(dt.timedelta(days=20)), NOW, f"{at}/log", retention.SweepOptions(max_rows=None, anchors=anchors, anchors_path=f"{at}/anchors"))
    read = df.sparkSession.read
    return integrity.verify_chain(read.parquet(f"{at}/log"), integrity.valid_anchors(read.parquet(f"{at}/anchors")), KEYS).select("is_valid", "verified", "reason", F.lit(taken).cast("long").alias("taken"))


on_log("sweep_chained", _swept, "SELECT true AS is_valid, count(*) FILTER (occurred_on_utc >= TIMESTAMP '2024-01-11') AS verified, 'None' AS reason, count(*) FILTER (occurred_on_utc < TIMESTAMP '2024-01-11') AS taken FROM audit_log")


def _ticks():
    """A clock that runs on by a second each time it is read."""
    now = iter(range(10**9))
    return lambda: float(next(now))


def _swept_in_slices(df: DataFrame) -> DataFrame:
    """Retention, stopped after every second slice and resumed until it is done."""
    sweep = sweeps.RetentionSweep(df.sparkSession, folder(df.sparkSession), retention.RetainFor(dt.timedelta(days=20)), slices=5, max_rows=None, clock=_ticks())
    calls = [sweep.run(df, NOW, dt.timedelta(seconds=3))]
    while not calls[-1].finished:
        calls.append(sweep.run(df, NOW, dt.timedelta(seconds=3)))
    return sweep.log(df).select("id", F.lit(sum(c.taken for c in calls)).cast("long").alias("taken"), F.lit(len(calls)).alias("calls"))


on_log("sweep_sliced", _swept_in_slices, "SELECT id, (SELECT count(*) FROM audit_log WHERE occurred_on_utc < TIMESTAMP '2024-01-11') AS taken, CAST(3 AS INTEGER) AS calls FROM audit_log WHERE occurred_on_utc >= TIMESTAMP '2024-01-11'")


def _compacted_in_slices(df: DataFrame) -> DataFrame:
    sweep = sweeps.CompactionSweep(df.sparkSession, folder(df.sparkSession), 20, 10, 25, slices=4, clock=_ticks())
    calls = [sweep.run(df, dt.timedelta(seconds=2))]
    while not calls[-1].finished:
        calls.append(sweep.run(df, dt.timedelta(seconds=2)))
    return sweep.log(df).select("id", F.lit(sum(c.taken for c in calls)).cast("long").alias("folded"))


# the hashes themselves: each row's text, then its keyed hash over that and the hash before it
_TEXT = " || ".join(f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-1:')" for x in (*_FIELDS[:14], "'0'"))
on_log("stamp_hashes", lambda df: integrity.stamp(df, integrity.no_anchors(df), 1, KEY).select("id", "previous_hash", "entry_hash"), f""", c AS (SELECT id, entity_type, entity_id, coalesce(tenant_id, '') AS tenant, {_TEXT} AS text_, row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) AS k FROM audit_log),
 h AS (WITH RECURSIVE w AS (SELECT *, CAST(NULL AS VARCHAR) AS previous_hash, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(text_ || '-1:')))) AS entry_hash FROM c WHERE k = 1 UNION ALL
  SELECT c.*, w.entry_hash, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(c.text_ || '64:' || w.entry_hash)))) FROM w JOIN c ON c.entity_type = w.entity_type AND c.entity_id = w.entity_id AND c.tenant = w.tenant AND c.k = w.k + 1) SELECT * FROM w)
 SELECT id, previous_hash, entry_hash FROM h""")  # fmt: skip

# custom columns: their texts in the hash, and providers that fail
_TYPED = lambda df: df.withColumns({"flag": F.col("action") == 1, "raw": F.col("id").cast("binary"), "seen": F.col("occurred_on_utc")})
_TYPED_FIELDS = (*_FIELDS[:14], "'3'", "'flag'", "CASE WHEN action = 1 THEN 'true' ELSE 'false' END", "'raw'", "to_base64(encode(id))", "'seen'", "strftime(occurred_on_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0Z'", "CAST(NULL AS VARCHAR)")
_TYPED_TEXT = " || ".join(f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-1:')" for x in _TYPED_FIELDS)
on_log("canonical_custom_columns", lambda df: (lambda rows: rows.select("id", cn.canonical(F.lit(None), cn.custom_texts(rows, ("flag", "raw", "seen"))).alias("canonical")))(_TYPED(df)), f"SELECT id, {_TYPED_TEXT} AS canonical FROM audit_log")
on_log(
    "custom_columns",
    lambda df: cp.with_custom_columns(df, {"actor": (F.upper("user_id"), F.when(F.col("user_id").isNull(), "no user")), "owner": (F.col("tenant_id"), F.when(tenant() == "", "no tenant")), "kind": F.col("user_type")}).select("id", "actor", "owner", "kind", "error"),
    """SELECT id, upper(user_id) AS actor, nullif(tenant_id, '') AS owner, user_type AS kind,
 nullif(concat_ws('; ', nullif(error, ''), CASE WHEN user_id IS NULL THEN 'AddColumn ''actor'': no user' END, CASE WHEN coalesce(tenant_id, '') = '' THEN 'AddColumn ''owner'': no tenant' END), '') AS error FROM audit_log""",
)

# compaction of one entity: of a tenant, of no tenant, of all tenants; and of the largest streams
_ASKED = {"one": ("t1", "tenant_id = 't1'"), "none": ("", "coalesce(tenant_id, '') = ''"), "all": (None, "true")}
for _name, (_tenant, _where) in _ASKED.items():
    on_log(f"compact_entity_{_name}", lambda df, t=_tenant: compaction.compact_entity(df, "shop.Session", "9", t, 3).select("id", "tenant_id", "action", "diff", F.get_json_object("snapshot", "$.value").alias("snapshot_value")),
           f""", f AS (SELECT id, row_number() OVER (ORDER BY occurred_on_utc, id) AS k, count(*) OVER () - 3 AS n FROM audit_log WHERE entity_type = 'shop.Session' AND entity_id = '9' AND {_where}),
 r AS (SELECT a.*, CASE WHEN n < 2 OR k > n OR k IS NULL THEN 'keep' WHEN k = n THEN 'boundary' ELSE 'remove' END AS fold FROM audit_log a LEFT JOIN f USING (id))
 SELECT id, tenant_id, CAST(CASE WHEN fold = 'boundary' AND action NOT IN (2, 3) THEN 0 ELSE action END AS INTEGER) AS action, CASE WHEN fold = 'boundary' THEN '[]' ELSE diff END AS diff, CASE WHEN fold = 'boundary' THEN json_extract_string(diff, '$[0].value') END AS snapshot_value FROM r WHERE fold <> 'remove'""")  # fmt: skip


def _compaction_swept(df: DataFrame) -> DataFrame:
    at = folder(df.sparkSession)
    taken = compaction.sweep(df, at, 20, 10, 25)
    return df.sparkSession.read.parquet(at).select("id", F.lit(taken).cast("long").alias("folded"))


on_log("compaction_sweep", _compaction_swept, f""", big AS (SELECT * FROM ({_SIZES}) WHERE total > 20 ORDER BY total DESC, entity_type, entity_id, tenant LIMIT 25), f AS ({_FOLD}),
 gone AS (SELECT a.id FROM audit_log a JOIN f USING (id) JOIN big b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND coalesce(a.tenant_id, '') = b.tenant WHERE fold = 'remove')
 SELECT id, (SELECT count(*) FROM gone) AS folded FROM audit_log WHERE id NOT IN (SELECT id FROM gone)""")  # fmt: skip
on_log("compaction_sliced", _compacted_in_slices, SQL["compaction_sweep"].split(f"WITH {derived.AUDIT_LOG_SQL}", 1)[1])
on_log("viewer_overview", lambda df: view.overview([CUSTOMER.entity_type], df.withColumn("error", F.when(F.col("action") == 2, "x")), ("region",)).select(F.array_join("audited_types", ",").alias("audited_types"), "queue_depth", F.array_join("custom_columns", ",").alias("custom_columns")), "SELECT 'shop.Customer' AS audited_types, count(*) FILTER (action <> 2) AS queue_depth, 'region' AS custom_columns FROM audit_log")
on_log("viewer_clamped_page", lambda df: view.log_page(df, 0, 9_999).select("id", "occurred_on_utc"), "SELECT id, occurred_on_utc FROM audit_log ORDER BY occurred_on_utc DESC, id DESC LIMIT 500")
on_log("entity_history", lambda df: view.entity_history(df, "shop.Order", "7").select("id", "action", "occurred_on_utc"), f"SELECT id, {_NAMES} AS action, occurred_on_utc FROM audit_log WHERE entity_type = 'shop.Order' AND entity_id = '7'")
on_log("verify_chain_break", lambda df: integrity.verify_chain(*_tampered(df), KEYS).select(*STREAM, "break_id"), f"""{_NUMBERED}, first_ AS (SELECT * FROM res WHERE reason IS NOT NULL ORDER BY entity_type, entity_id, tenant LIMIT 1)
 SELECT f.entity_type, f.entity_id, f.tenant, coalesce(min_by(b.id, b.walk) FILTER (b.reason IS NOT NULL), max_by(b.id, b.walk)) AS break_id FROM first_ f JOIN bad b ON f.entity_type = b.entity_type AND f.entity_id = b.entity_id AND f.tenant = b.tenant GROUP BY 1, 2, 3""")  # fmt: skip
on_log("batch_last_hash", lambda df: ag.batch_summary(integrity.stamp(df, integrity.no_anchors(df), 1, KEY)).select(*STREAM, "last_hash", "added"),
       SQL["stamp_hashes"].split(f"WITH {derived.AUDIT_LOG_SQL}", 1)[1].rsplit(" SELECT id, previous_hash, entry_hash FROM h", 1)[0] + " SELECT entity_type, entity_id, tenant, max_by(entry_hash, k) AS last_hash, count(*) AS added FROM h GROUP BY 1, 2, 3")
