"""Retention: which rows a policy expires, and what becomes of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import segments
from ..schema import HistoryError
from ..sources.shared import stored
from .filters import instant
from .integrity import prunable, pruned_anchors

MAX_ROWS_PER_SWEEP = 10_000


@dataclass(frozen=True)
class RetainFor:
    age: dt.timedelta


@dataclass(frozen=True)
class RetainCount:
    count: int


@dataclass(frozen=True)
class PerEntityType:
    policies: dict[str, RetainFor | RetainCount]
    fallback: RetainFor | RetainCount | None = None


@dataclass(frozen=True)
class PerTenant:
    """Rows without a tenant go by the fallback."""

    policies: dict[str, RetainFor | RetainCount | PerEntityType]
    fallback: RetainFor | RetainCount | PerEntityType | None = None


Policy = RetainFor | RetainCount | PerEntityType | PerTenant


def _limits(policy: Policy | None, now: dt.datetime) -> tuple[Column, Column]:
    """For each row: the instant before which it expires, and how many rows of its group stay."""
    none = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("long")
    if policy is None:
        return none
    if isinstance(policy, RetainFor):
        return instant(now - policy.age), none[1]
    if isinstance(policy, RetainCount):
        return none[0], F.lit(policy.count).cast("long")
    by = "tenant_id" if isinstance(policy, PerTenant) else "entity_type"
    before, keep = _limits(policy.fallback, now)
    for value, inner in policy.policies.items():
        own = _limits(inner, now)
        before, keep = F.when(F.col(by) == value, own[0]).otherwise(before), F.when(F.col(by) == value, own[1]).otherwise(keep)
    return before, keep


def expired(df: DataFrame, policy: Policy, now: dt.datetime, max_rows: int | None = MAX_ROWS_PER_SWEEP) -> DataFrame:
    """The rows that a sweep takes: strictly older than their age, or beyond the newest
    of their (type, entity, tenant), in which null and '' are two groups. Of more than
    max_rows (None: no limit) the oldest go first; under a plain RetainCount, those of
    the first groups (see expired_by_count)."""
    if isinstance(policy, RetainCount) and max_rows:
        return expired_by_count(df, policy.count, max_rows)
    before, keep = _limits(policy, now)
    rows = df.withColumns({"_before": before, "_keep": keep})
    newest = Window.partitionBy("entity_type", "entity_id", "tenant_id").orderBy(F.desc("occurred_on_utc"), F.desc(F.col("chain_sequence").isNull()), F.desc("chain_sequence"), F.desc("id"))
    if _counts(policy):
        rows = rows.withColumn("_place", F.row_number().over(newest))
        due = (F.col("occurred_on_utc") < F.col("_before")) | (F.col("_place") > F.col("_keep"))
    else:
        due = F.col("occurred_on_utc") < F.col("_before")
    out = rows.where(due).select(*df.columns)
    return out.orderBy("occurred_on_utc", F.col("chain_sequence").isNull(), "chain_sequence", "id").limit(max_rows) if max_rows else out


_GROUP = ("entity_type", "entity_id", "tenant_id")


def expired_by_count(df: DataFrame, keep: int, max_rows: int) -> DataFrame:
    """What RetainCount takes with a budget: groups in order of type, entity and tenant (null
    first) are worked off until max_rows are taken; of the group in which that happens, the
    newest that are too many go first. Counts of groups are added up in ranges, and only
    rows of groups that the budget reaches are put in order, those of a large group by many tasks."""
    groups = df.groupBy(*_GROUP).agg((F.count("*") - keep).alias("_over")).where("_over > 0")
    added = segments.running(groups.withColumn("_all", F.lit(0)), ["_all"], list(_GROUP), sums={"_upto": F.col("_over")})
    reached = added.withColumn("_taken", F.col("_upto") - F.col("_over")).where(F.col("_taken") < max_rows)
    reached = stored(reached.select(*[F.col(c).alias(f"_{c}") for c in _GROUP], "_taken"))
    rows = df.join(reached, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _GROUP])).select(*df.columns, "_taken")
    newest = [F.desc("occurred_on_utc"), F.desc(F.col("chain_sequence").isNull()), F.desc("chain_sequence"), F.desc("id")]
    placed = segments.running(rows, list(_GROUP), newest, sums={"_place": F.lit(1)})
    return placed.where((F.col("_place") > keep) & (F.col("_taken") + F.col("_place") - keep <= max_rows)).select(*df.columns)


def _counts(policy: Policy | None) -> bool:
    if isinstance(policy, (PerTenant, PerEntityType)):
        return any(map(_counts, [*policy.policies.values(), policy.fallback]))
    return isinstance(policy, RetainCount)


def survivors(df: DataFrame, victims: DataFrame) -> DataFrame:
    return df.join(victims.select("id"), "id", "left_anti").select(*df.columns)


Archiver = Callable[[DataFrame], None]


def dry_run(victims: DataFrame) -> int:
    return victims.count()


def copy_to(path: str, mapped: Callable[[DataFrame], DataFrame] = lambda df: df) -> Archiver:
    """Appends the rows, perhaps in another form, to an archive table."""
    return lambda victims: mapped(victims).write.mode("append").parquet(path)


@dataclass
class SweepOptions:
    max_rows: int = MAX_ROWS_PER_SWEEP
    dry_run: bool = False
    archivers: list[Archiver] = field(default_factory=list)
    #: Of a chained log: its anchors, and where to write those that hold after the sweep.
    anchors: DataFrame | None = None
    anchors_path: str | None = None


def sweep(df: DataFrame, policy: Policy, now: dt.datetime, out_path: str, options: SweepOptions | None = None) -> int:
    """Archives what is due, then writes the survivors to a new path, which the caller
    publishes. Archives come first: an interrupted sweep loses nothing. Of chained
    streams only what keeps their chain whole is taken, and their anchors move. What
    is due is decided once and stored. Returns the number of rows taken."""
    options = options or SweepOptions()
    chained = options.anchors is not None
    if chained and not options.dry_run and not options.anchors_path:
        raise ValueError("the anchors of a chained log change, so they need a path")
    victims = expired(df, policy, now, options.max_rows)
    if chained:
        victims = prunable(victims, options.anchors)
    if options.dry_run:
        return dry_run(victims)
    victims = stored(victims)
    if not chained and victims.where("entry_hash is not null").limit(1).count():
        raise HistoryError("rows of a chain go only with its anchors, else the chain reads as broken")
    for archive in options.archivers:
        archive(victims)
    survivors(df, victims).write.mode("errorifexists").parquet(out_path)
    if chained:
        pruned_anchors(options.anchors, victims).write.mode("errorifexists").parquet(options.anchors_path)
    return victims.count()
