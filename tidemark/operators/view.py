"""Human-readable views and events of audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import is_json
from ..schema import EMPTY_DIFF, action_name
from .aggregate import queue_depth

_OPS = "array<struct<op:string,path:string,value:string>>"


def to_event(df: DataFrame) -> DataFrame:
    """What subscribers get; an empty diff is left out."""
    return df.select(
        F.col("id").alias("audit_log_id"), "entity_type", F.col("entity_id").alias("entity_key"), action_name().alias("action"),
        F.col("occurred_on_utc").alias("at"), "tenant_id", "user_id", "correlation_id", F.nullif("diff", F.lit(EMPTY_DIFF)).alias("diff"),
    )


def changes(diff: Column, labels: dict[str, str] | None = None) -> Column:
    """array<struct<path, old_value, new_value, kind, label>> of a diff. A diff that is
    no JSON array has none; operations without op or path are left out; old values are unknown."""
    ops = F.when(is_json(diff) & F.ltrim(diff).startswith("["), F.from_json(diff, _OPS))
    known = F.filter(F.coalesce(ops, F.array().cast(_OPS)), lambda o: o["op"].isNotNull() & o["path"].isNotNull())
    table = F.create_map(*[F.lit(x) for pair in (labels or {}).items() for x in pair]) if labels else None

    def change(o: Column) -> Column:
        top = F.replace(F.replace(F.get(F.split(o["path"], "/"), F.lit(1)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        label = F.element_at(table, top) if table is not None else F.lit(None).cast("string")
        kind = F.when(o["op"] == "add", "Added").when(o["op"] == "remove", "Removed").otherwise("Modified")
        return F.struct(o["path"].alias("path"), F.lit(None).cast("string").alias("old_value"), F.when(o["op"] != "remove", o["value"]).alias("new_value"), kind.alias("kind"), label.alias("label"))

    return F.transform(known, change)


def render(df: DataFrame, labels: dict[str, str] | None = None, custom: tuple[str, ...] = (), entity_label: str | None = None) -> DataFrame:
    values = F.create_map(*[x for c in custom for x in (F.lit(c), F.col(c).cast("string"))]) if custom else F.lit(None).cast("map<string,string>")
    return df.select(
        "id", "entity_type", "entity_id", F.coalesce(F.lit(entity_label), F.col("entity_type")).alias("entity_label"), action_name().alias("action"), "occurred_on_utc",
        F.coalesce("user_display", "user_id").alias("user"), "correlation_id", changes(F.col("diff"), labels).alias("changes"), values.alias("custom_columns"),
    )


def render_many(df: DataFrame, **options) -> DataFrame:
    return render(df, **options).orderBy("occurred_on_utc", "id")


def log_page(df: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the newest rows, rendered. Pages begin at 1 and hold up to 500 rows; a
    lower page is the first, a larger size is 500, and one below 1 is 50."""
    take, page = (min(size, 500) if size > 0 else 50), max(page, 1)
    return render(df.orderBy(F.desc("occurred_on_utc"), F.desc("id")).offset((page - 1) * take).limit(take))


def entity_history(df: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    return render_many(df.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)))


def meta(df: DataFrame) -> DataFrame:
    """Types with their number of rows."""
    return df.groupBy("entity_type").agg(F.count("*").alias("rows"))


def overview(types: list[str], queue: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """One row: the audited types, how many queue entries wait, and the custom columns."""
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return queue_depth(queue).select(texts(types).alias("audited_types"), F.col("waiting").alias("queue_depth"), texts(custom).alias("custom_columns"))
