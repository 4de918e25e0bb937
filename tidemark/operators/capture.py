"""Change capture: before and after images of records become audit rows with a JSON Patch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from ..schema import DELETED, EMPTY_DIFF, INSERTED, REDACTED, SOFT_DELETED, UPDATED, tenant

CAPTURE, EXCLUDE, HASH, REDACT = "capture", "exclude", "hash", "redact"


@dataclass(frozen=True)
class EntityConfig:
    """How a type is audited. Where a column has several rules, the order is exclude, hash, redact."""

    entity_type: str
    keys: tuple[str, ...]
    base_type: str | None = None
    excluded: frozenset[str] = frozenset()
    hashed: frozenset[str] = frozenset()
    redacted: frozenset[str] = frozenset()
    labels: dict[str, str] = field(default_factory=dict)
    soft_delete: str | None = None

    def rule(self, column: str) -> str:
        return EXCLUDE if column in self.excluded else HASH if column in self.hashed else REDACT if column in self.redacted else CAPTURE


class Registry:
    """Audited types by name."""

    def __init__(self) -> None:
        self.configs: dict[str, EntityConfig] = {}

    def register(self, config: EntityConfig) -> EntityConfig:
        self.configs[config.entity_type] = config
        return config

    def is_audited(self, entity_type: str) -> bool:
        return entity_type in self.configs


def entity_key(*columns: Column) -> Column:
    """A single key as it is; of several, each with | written as %7C, joined by |."""
    if len(columns) == 1:
        return columns[0].cast("string")
    return F.concat_ws("|", *[F.replace(c.cast("string"), F.lit("|"), F.lit("%7C")) for c in columns])


def json_value(column: Column, kind: str) -> Column:
    """A column's JSON text; 'null' for null."""
    if kind == "string":
        text = quoted(column)
    elif kind == "boolean":
        text = F.when(column, "true").otherwise("false")
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        text = column.cast("string")
    elif kind in ("float", "double"):
        text = F.when(F.isnan(column) | (F.abs(column) == float("inf")), quoted(column.cast("string"))).otherwise(column.cast("string"))
    elif kind == "binary":
        text = quoted(F.base64(column))
    elif kind.startswith("timestamp"):
        text = quoted(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'"))
    elif kind == "date":
        text = quoted(F.date_format(column, "yyyy-MM-dd"))
    elif kind.startswith(("struct", "array", "map")):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = quoted(column.cast("string"))
    return F.when(column.isNull(), "null").otherwise(text)


def ruled(column: Column, kind: str, rule: str) -> Column:
    """A property's JSON text under its rule."""
    if rule == REDACT:
        return F.lit(f'"{REDACTED}"')
    if rule == HASH:
        source = column if kind == "string" else json_value(column, kind)
        return F.when(column.isNull(), "null").otherwise(F.concat(F.lit('"'), F.sha2(source, 256), F.lit('"')))
    return json_value(column, kind)


def snapshot(properties: list[tuple[str, Column]]) -> Column:
    """An object's JSON text."""
    if not properties:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(_key(name)), F.lit(":"), value) for name, value in properties]), F.lit("}"))


def _key(name: str) -> str:
    from ..functions.jsonpatch import dump

    return dump(name)


def capture(before: DataFrame, after: DataFrame, config: EntityConfig) -> DataFrame:
    """(entity_type, entity_base_type, entity_id, action, diff, snapshot, before_json,
    after_json) of every record that came, changed or went. A record of which only
    excluded or redacted columns changed gives a row with an empty diff. Properties
    are compared as columns; the diff is flat: one operation for each property. A column
    that one image lacks is null there."""
    from ..functions.jsonpatch import escape

    keys, kinds = list(config.keys), dict(after.dtypes) | dict(before.dtypes)
    before, after = (x.withColumns({c: F.lit(None).cast(kinds[c]) for c in y.columns if c not in x.columns}) for x, y in ((before, after), (after, before)))
    names = [c for c in before.columns if c not in config.keys]
    one = before.select(*keys, F.struct(*names).alias("b"))
    two = after.select(*keys, F.struct(*names).alias("a"))
    rows = one.join(two, keys, "full_outer")
    came, went = F.col("b").isNull(), F.col("a").isNull()
    rows = rows.where(came | went | ~F.col("a").eqNullSafe(F.col("b")))
    soft = F.lit(False)
    if config.soft_delete:
        soft = ~F.coalesce(F.col(f"b.{config.soft_delete}"), F.lit(False)) & F.coalesce(F.col(f"a.{config.soft_delete}"), F.lit(False))
    action = F.when(came, INSERTED).when(went, DELETED).when(soft, SOFT_DELETED).otherwise(UPDATED)
    captured = [c for c in names if config.rule(c) != EXCLUDE]
    old = [(c, ruled(F.col(f"b.{c}"), kinds[c], config.rule(c))) for c in captured]
    new = [(c, ruled(F.col(f"a.{c}"), kinds[c], config.rule(c))) for c in captured]
    at = {c: _key("/" + escape(c)) for c in captured}
    removes = [F.concat(F.lit(f'{{"op":"remove","path":{at[c]}}}')) for c in captured]
    adds = [F.concat(F.lit(f'{{"op":"add","path":{at[c]},"value":'), v, F.lit("}")) for c, v in new]
    changes = [F.when(v != w, F.concat(F.lit(f'{{"op":"replace","path":{at[c]},"value":'), w, F.lit("}"))) for (c, v), (_, w) in zip(old, new)]
    listed = [F.concat(F.lit("["), F.concat_ws(",", *x), F.lit("]")) if x else F.lit(EMPTY_DIFF) for x in (adds, removes, changes)]
    out = rows.select(
        F.lit(config.entity_type).alias("entity_type"), F.lit(config.base_type).cast("string").alias("entity_base_type"), entity_key(*map(F.col, keys)).alias("entity_id"),
        action.alias("action"), F.when(came, listed[0]).when(went, listed[1]).otherwise(listed[2]).alias("diff"),
        F.when(~came, snapshot(old)).alias("before_json"), F.when(~went, snapshot(new)).alias("after_json"),
    )
    # a record's state stays with its end: before a deletion, after a soft one
    return out.withColumn("snapshot", F.when(F.col("action") == DELETED, F.col("before_json")).when(F.col("action") == SOFT_DELETED, F.col("after_json")))


def with_custom_columns(df: DataFrame, providers: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Adds columns that the caller defines. A provider is any column expression, or one
    with a text of why it fails, null where it doesn't. Where it fails, the column is
    null and the row's error tells of it, after what the error held before."""
    pairs = {name: p if isinstance(p, tuple) else (p, F.lit(None).cast("string")) for name, p in providers.items()}
    told = [F.concat(F.lit(f"AddColumn '{name}': "), failure) for name, (_, failure) in pairs.items()]
    values = {name: F.when(failure.isNull(), value) for name, (value, failure) in pairs.items()}
    return df.withColumns(values | {"error": F.nullif(F.concat_ws("; ", F.nullif("error", F.lit("")), *told), F.lit(""))})


@dataclass(frozen=True)
class Every:
    """Each updates-th error-free update keeps a snapshot."""

    updates: int

    def __post_init__(self) -> None:
        if self.updates < 1:
            raise ValueError("a snapshot comes every update at most")

    def due(self, since: int, last: int | None, now: int) -> bool:
        return since >= self.updates


@dataclass(frozen=True)
class EveryDuration:
    """The first error-free update keeps a snapshot, and each that comes so long after the last one kept."""

    elapsed: dt.timedelta

    def __post_init__(self) -> None:
        if self.elapsed <= dt.timedelta(0):
            raise ValueError("the duration must be positive")

    def due(self, since: int, last: int | None, now: int) -> bool:
        return last is None or now - last >= self.elapsed // dt.timedelta(microseconds=1)


Policy = Every | EveryDuration


def snapshot_every(df: DataFrame, n: int) -> DataFrame:
    """Marks (snapshot_due) every n-th update without an error of each stream."""
    if n < 1:
        raise ValueError("n must be at least 1")
    counts = (F.col("action") == UPDATED) & F.col("error").isNull()
    stream = Window.partitionBy("entity_type", "entity_id", tenant()).orderBy("occurred_on_utc", "id")
    number = F.sum(F.when(counts, 1).otherwise(0)).over(stream)
    return df.withColumn("snapshot_due", counts & (number % n == 0))


def snapshot_every_duration(df: DataFrame, seconds: int) -> DataFrame:
    """Marks the updates without an error that come at least so long after the stream's
    last marked one; the first is marked. Returns the rows' stream, id, time and mark."""
    from ..plans.fold import fold_sorted

    if seconds <= 0:
        raise ValueError("the duration must be positive")
    rows = df.select("entity_type", "entity_id", tenant().alias("tenant"), "id", "occurred_on_utc", ((F.col("action") == UPDATED) & F.col("error").isNull()).alias("counts"))

    def step(state, row):
        due = False
        if row["counts"]:
            last = state["last"]
            due = last is None or (row["occurred_on_utc"] - last).total_seconds() >= seconds
            if due:
                state["last"] = row["occurred_on_utc"]
        yield {c: row[c] for c in ("entity_type", "entity_id", "tenant", "id", "occurred_on_utc")} | {"snapshot_due": due}

    return fold_sorted(rows, ["entity_type", "entity_id", "tenant"], ["occurred_on_utc", "id"], lambda: {"last": None}, step, lambda state: iter(()), "entity_type string, entity_id string, tenant string, id string, occurred_on_utc timestamp_ntz, snapshot_due boolean")


def policy_snapshots(df: DataFrame, policy: Policy, after: str = "after_json") -> DataFrame:
    """Audit rows of a batch whose due updates keep the state after them, a column ``after``, as their snapshot."""
    if isinstance(policy, Every):
        marked = snapshot_every(df, policy.updates)
    else:
        due = snapshot_every_duration(df, policy.elapsed.total_seconds()).where("snapshot_due").select("id", "snapshot_due")
        marked = df.join(due, "id", "left")
    return marked.withColumn("snapshot", F.when(F.coalesce("snapshot_due", F.lit(False)), F.col(after)).otherwise(F.col("snapshot"))).select(*df.columns)
