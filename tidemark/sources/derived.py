"""An audit log, and before and after images, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-01-31T00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    kind = F.col("event_type")
    rows = e.select(
        F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.when(kind == "purchase", "shop.Order").when(kind == "signup", "shop.Customer").when(kind == "error", "shop.Incident").otherwise("shop.Session").alias("entity_type"),
        F.when(kind.isin("purchase", "signup"), "shop.Sales").alias("entity_base_type"),
        (F.col("user_id") % 40).cast("string").alias("entity_id"),
        F.col("ts").alias("occurred_on_utc"),
        F.when(n % 11 != 0, F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string"))).alias("user_id"),
        F.lit(None).cast("string").alias("user_display"),
        F.when(n % 3 == 0, "user").when(n % 3 == 1, "system").otherwise("job").alias("user_type"),
        F.when(n % 4 == 1, "").when(n % 4 == 2, "t1").when(n % 4 == 3, "t2").alias("tenant_id"),
        F.concat(F.lit("corr-"), F.floor(n / 5).cast("string")).alias("correlation_id"),
        F.concat(
            F.lit('[{"op":"add","path":"/value","value":'), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("}"),
            F.when(n % 5 == 0, F.concat(F.lit(',{"op":"add","path":"/city","value":"c'), (n % 9).cast("string"), F.lit('"}'))).otherwise(""),
            F.when(n % 7 == 0, F.lit(',{"op":"add","path":"/valueCode","value":{"path":"/city"}}')).otherwise(""), F.lit("]"),
        ).alias("diff"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("snapshot", "string"), ("error", "string"), ("entry_hash", "string"), ("previous_hash", "string"), ("hash_key_id", "int"), ("chain_sequence", "long"))],
        n.alias("event_id"),
    )
    stream = Window.partitionBy("entity_type", "entity_id", F.coalesce("tenant_id", F.lit(""))).orderBy("occurred_on_utc", "id")
    action = F.when(F.row_number().over(stream) == 1, 0).when(n % 17 == 0, 2).when(n % 23 == 0, 3).otherwise(1)
    return rows.withColumn("action", action).drop("event_id")


#: The same as common table expressions, for SQL over the table events.
AUDIT_LOG_SQL = """
e AS (SELECT event_id AS n, ts, user_id AS u, event_type AS k, value AS v FROM events),
rows_ AS (SELECT n, '00000000-0000-0000-0000-' || lpad(CAST(n AS VARCHAR), 12, '0') AS id,
  CASE k WHEN 'purchase' THEN 'shop.Order' WHEN 'signup' THEN 'shop.Customer' WHEN 'error' THEN 'shop.Incident' ELSE 'shop.Session' END AS entity_type,
  CASE WHEN k IN ('purchase', 'signup') THEN 'shop.Sales' END AS entity_base_type,
  CAST(u % 40 AS VARCHAR) AS entity_id, ts AS occurred_on_utc,
  CASE WHEN n % 11 <> 0 THEN 'u' || CAST(u % 25 AS VARCHAR) END AS user_id, CAST(NULL AS VARCHAR) AS user_display,
  CASE n % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'system' ELSE 'job' END AS user_type,
  CASE n % 4 WHEN 1 THEN '' WHEN 2 THEN 't1' WHEN 3 THEN 't2' END AS tenant_id,
  'corr-' || CAST(n // 5 AS VARCHAR) AS correlation_id,
  '[{"op":"add","path":"/value","value":' || CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR) || '}'
    || CASE WHEN n % 5 = 0 THEN ',{"op":"add","path":"/city","value":"c' || CAST(n % 9 AS VARCHAR) || '"}' ELSE '' END
    || CASE WHEN n % 7 = 0 THEN ',{"op":"add","path":"/valueCode","value":{"path":"/city"}}' ELSE '' END || ']' AS diff,
  CAST(NULL AS VARCHAR) AS snapshot, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS entry_hash,
  CAST(NULL AS VARCHAR) AS previous_hash, CAST(NULL AS INTEGER) AS hash_key_id, CAST(NULL AS BIGINT) AS chain_sequence FROM e),
audit_log AS (SELECT * EXCLUDE (n), CASE WHEN row_number() OVER (PARTITION BY entity_type, entity_id, coalesce(tenant_id, '') ORDER BY occurred_on_utc, id) = 1 THEN 0
  WHEN n % 17 = 0 THEN 2 WHEN n % 23 = 0 THEN 3 ELSE 1 END AS action FROM rows_)
"""


def customer_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers before and after: every seventh has another balance and segment,
    every 13th is gone, and for every 17th a new one came."""
    before = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    changed = before.where(k % 13 != 0).withColumns({"c_acctbal": F.when(k % 7 == 0, 1.5).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 14 == 0, None).otherwise(F.col("c_mktsegment"))})
    added = before.where(k % 17 == 0).withColumns({"c_custkey": k + 10_000_000, "c_name": F.concat(F.lit("new "), "c_name")})
    return before, changed.unionByName(added)


CUSTOMER_IMAGES_SQL = """
before_ AS (SELECT * FROM customer),
after_ AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0
  UNION ALL SELECT c_custkey + 10000000, 'new ' || c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 17 = 0)
"""
