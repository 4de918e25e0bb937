"""Composable filters over an audit log: each takes and returns a DataFrame, for ``df.transform``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VERBS

Filter = Callable[[DataFrame], DataFrame]


def instant(value: dt.datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat() if isinstance(value, dt.datetime) else value).cast("timestamp_ntz")


def _as_text(value) -> str:
    return value.isoformat() if isinstance(value, dt.datetime) else str(value)


def between_dates(first, last) -> Filter:
    """Both ends belong to it."""
    if _as_text(last) < _as_text(first):
        raise ValueError("the range ends before it begins")
    return lambda df: df.where(F.col("occurred_on_utc").between(instant(first), instant(last)))


def within_last(window: dt.timedelta, now: dt.datetime) -> Filter:
    if window <= dt.timedelta(0):
        raise ValueError("the window must be positive")
    return lambda df: df.where(F.col("occurred_on_utc") >= instant(now - window))


def equals(column: str, value: str | int) -> Filter:
    if value is None or value == "" and column != "tenant_id":
        raise ValueError(f"{column} needs a value")
    return lambda df: df.where(F.col(column) == value)


def by_user(user: str) -> Filter:
    return equals("user_id", user)


def by_users(users: Sequence[str]) -> Filter:
    return lambda df: df.where(F.col("user_id").isin(*users)) if users else df.where(F.lit(False))


def by_user_type(kind: str) -> Filter:
    return equals("user_type", kind)


def by_tenant(name: str) -> Filter:
    return equals("tenant_id", name)


def by_action(action: int) -> Filter:
    return equals("action", action)


def by_correlation(correlation: str) -> Filter:
    return equals("correlation_id", correlation)


def matching(predicate: Column | str) -> Filter:
    return lambda df: df.where(predicate)


def audit_for(entity_type: str, base_type: str | None = None) -> Filter:
    """Rows of a type, or of any type whose base it is."""
    return lambda df: df.where((F.col("entity_type") == entity_type) | (F.col("entity_base_type") == (base_type or entity_type)))


def no_tenant() -> Filter:
    return lambda df: df.where(F.coalesce("tenant_id", F.lit("")) == "")


class AllTenants:
    """The scope of a session without tenants, or of a read that crosses them."""


def tenant_scope(scope: str | None | type[AllTenants]) -> Filter:
    """Fails closed: a session that has tenants but no current one sees rows without a tenant only."""
    if scope is AllTenants:
        return lambda df: df
    return no_tenant() if scope is None else by_tenant(scope) if scope else no_tenant()


def import_batch(tag: str) -> Filter:
    return lambda df: df.where(F.col("correlation_id").startswith(f"import:{tag}"))


def check_pointer(path: str) -> str:
    """A JSON pointer: it begins with a slash, and each ~ is followed by 0 or 1."""
    if not path.startswith("/"):
        raise ValueError("a path begins with a slash")
    if any(path[k + 1 : k + 2] not in ("0", "1") for k, c in enumerate(path) if c == "~"):
        raise ValueError("each ~ of a path is followed by 0 or 1")
    return path


def escaped_pointer(path: str) -> str:
    """A pointer as it stands in a diff's text."""
    return check_pointer(path).replace("\\", "\\\\").replace('"', '\\"')


def changed_path(path: str) -> Filter:
    """Rows whose diff has an operation at the path or below it. Looks for an
    operation's text, so a value that looks like a path doesn't count."""
    escaped = escaped_pointer(path)
    tokens = [f'"op":"{verb}","path":"{escaped}{end}' for verb in VERBS for end in ('"', "/")]
    return lambda df: df.where(reduce(or_, (F.col("diff").contains(t) for t in tokens)))
