"""NDJSON export: one object a line, its properties in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import is_json, quoted
from ..schema import ACTIONS, AUDIT_LOG, action_name, iso

# fixed values: property names of the export and the columns they show, in order
PROPERTIES = (
    ("id", "id"), ("entityType", "entity_type"), ("entityBaseType", "entity_base_type"), ("entityId", "entity_id"), ("action", "action"), ("occurredOnUtc", "occurred_on_utc"),
    ("userId", "user_id"), ("userDisplay", "user_display"), ("userType", "user_type"), ("tenantId", "tenant_id"), ("correlationId", "correlation_id"),
    ("diff", "diff"), ("snapshot", "snapshot"), ("error", "error"), ("entryHash", "entry_hash"), ("previousHash", "previous_hash"), ("hashKeyId", "hash_key_id"),
)


def _value(column: str) -> Column:
    c = F.col(column)
    if column in ("diff", "snapshot"):  # JSON as it is, anything else as a string
        text = F.when(is_json(c), c).otherwise(quoted(c))
    elif column == "hash_key_id":
        text = c.cast("string")
    else:
        text = quoted({"action": action_name(), "occurred_on_utc": iso(c)}.get(column, c))
    return F.when(c.isNull(), "null").otherwise(text)


def ndjson(df: DataFrame) -> DataFrame:
    """(occurred_on_utc, id, line)"""
    parts = [F.concat(F.lit(f'{"," if k else ""}"{name}":'), _value(column)) for k, (name, column) in enumerate(PROPERTIES)]
    return df.select("occurred_on_utc", "id", F.concat(F.lit("{"), *parts, F.lit("}")).alias("line"))


def write_ndjson(df: DataFrame, path: str) -> None:
    """Text files that hold the rows oldest first: a range of time in each, in order."""
    ndjson(df).repartitionByRange("occurred_on_utc", "id").sortWithinPartitions("occurred_on_utc", "id").select("line").write.text(path)


def read_ndjson(spark, path: str) -> DataFrame:
    """An exported log, with the log's types."""
    raw = spark.read.text(path)
    names = ", ".join(f"{name} string" for name, _ in PROPERTIES)
    parsed = raw.select(F.from_json("value", names).alias("r"))
    kinds = dict(c.split() for c in AUDIT_LOG.split(", "))
    made = {
        "action": F.when(F.col("r.action").isin(*ACTIONS), F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("r.action")) - 1),
        "occurred_on_utc": F.to_timestamp_ntz(F.substring("r.occurredOnUtc", 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
    }
    return parsed.select(*[made.get(column, F.col(f"r.{name}")).cast(kinds[column]).alias(column) for name, column in PROPERTIES])
