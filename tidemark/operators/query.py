"""The history query: criteria that are all optional, an order, and a page."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as f

SORT_FIELDS = {"occurred_on": "occurred_on_utc", "entity_type": "entity_type", "action": "action", "user_id": "user_id"}
DEFAULT_TAKE = 100


@dataclass(frozen=True)
class HistoryQuery:
    entity_type: str | None = None
    entity_base_type: str | None = None
    entity_id: str | None = None
    action: int | None = None
    user_id: str | None = None
    user_type: str | None = None
    tenant_id: str | None = None
    correlation_id: str | None = None
    entity_types: tuple[str, ...] = ()
    actions: tuple[int, ...] = ()
    from_utc: dt.datetime | None = None
    to_utc: dt.datetime | None = None
    changed_path: str | None = None
    sort_by: str = "occurred_on"
    newest_first: bool = True
    skip: int = 0
    take: int = DEFAULT_TAKE

    def __post_init__(self) -> None:
        if self.take < 1 or self.skip < 0:
            raise ValueError("a page takes at least one row and skips none or more")
        if self.from_utc and self.to_utc and self.to_utc < self.from_utc:
            raise ValueError("the range ends before it begins")
        if self.sort_by not in SORT_FIELDS:
            raise ValueError(f"can't sort by {self.sort_by}")
        if self.changed_path is not None:
            f.check_pointer(self.changed_path)

    def filtered(self, df: DataFrame) -> DataFrame:
        for name in ("entity_type", "entity_base_type", "entity_id", "action", "user_id", "user_type", "tenant_id", "correlation_id"):
            if (value := getattr(self, name)) is not None:
                df = df.where(F.col(name) == value)
        for name, values in (("entity_type", self.entity_types), ("action", self.actions)):
            if values:
                df = df.where(F.col(name).isin(*values))
        if self.from_utc:
            df = df.where(F.col("occurred_on_utc") >= f.instant(self.from_utc))
        if self.to_utc:
            df = df.where(F.col("occurred_on_utc") <= f.instant(self.to_utc))
        return df.transform(f.changed_path(self.changed_path)) if self.changed_path is not None else df

    def order(self) -> list[Column]:
        """The field, then time, then id, all in one direction; rows without the field last in both."""
        return [F.col(n).desc_nulls_last() if self.newest_first else F.col(n).asc_nulls_last() for n in self._names()]

    def _names(self) -> list[str]:
        return list(dict.fromkeys((SORT_FIELDS[self.sort_by], "occurred_on_utc", "id")))

    def page(self, df: DataFrame) -> DataFrame:
        return self.filtered(df).orderBy(*self.order()).offset(self.skip).limit(self.take)

    def meta(self, df: DataFrame) -> DataFrame:
        """One row: total, items, has_more."""
        total = self.filtered(df).agg(F.count("*").alias("total"))
        items = F.greatest(F.lit(0), F.least(F.lit(self.take), F.col("total") - self.skip)).cast("long")
        return total.select("total", items.alias("items"), (items + self.skip < F.col("total")).alias("has_more"))

    def cursor(self, row) -> tuple:
        """Where a row stands in this query's order."""
        return tuple(row[n] for n in self._names())

    def after(self, df: DataFrame, cursor: tuple | None) -> DataFrame:
        """The rows behind a cursor, whatever their number before it: nothing is skipped row by row."""
        rows = self.filtered(df)
        if cursor is None:
            return rows
        behind = F.lit(False)
        for name, value in reversed(list(zip(self._names(), cursor, strict=True))):
            c = F.col(name)
            if value is None:  # rows without the field come last, so only their own rest is behind
                behind = c.isNull() & behind
            else:
                at = f.instant(value) if isinstance(value, dt.datetime) else F.lit(value)
                behind = c.isNull() | (c < at if self.newest_first else c > at) | ((c == at) & behind)
        return rows.where(F.coalesce(behind, F.lit(False)))

    def page_after(self, df: DataFrame, cursor: tuple | None = None) -> DataFrame:
        """The first ``take`` rows behind a cursor (None: from the start), in order."""
        return self.after(df, cursor).orderBy(*self.order()).limit(self.take)

    def walk(self, df: DataFrame, cursor: tuple | None = None):
        """Yields (rows, cursor) page by page; a cursor that was kept resumes the walk."""
        while rows := self.page_after(df, cursor).collect():
            cursor = self.cursor(rows[-1])
            yield rows, cursor
            if len(rows) < self.take:
                return

    def pages(self, df: DataFrame, size: int = 500):
        """Iterates over rows in order, fetching a partition at a time."""
        return replace(self, take=size).filtered(df).orderBy(*self.order()).toLocalIterator(prefetchPartitions=True)


def newest_first() -> f.Filter:
    """The exact reverse of oldest_first."""
    return lambda df: df.orderBy(*_chain_order(False))


def oldest_first() -> f.Filter:
    """By time; rows without a place in the chain come after those of the same time that have one."""
    return lambda df: df.orderBy(*_chain_order(True))


def _chain_order(ascending: bool) -> list[Column]:
    keys = [F.col("occurred_on_utc"), F.col("chain_sequence").isNull(), F.col("chain_sequence"), F.col("id")]
    return [k.asc() if ascending else k.desc() for k in keys]
