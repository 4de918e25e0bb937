"""The audit log's columns and fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSERTED, UPDATED, DELETED, SOFT_DELETED = range(4)
# fixed values: names of the actions and of the diff's verbs
ACTIONS = ("Inserted", "Updated", "Deleted", "SoftDeleted")
VERBS = ("add", "remove", "replace", "move", "copy", "test")
EMPTY_DIFF = "[]"
REDACTED = "<redacted>"

AUDIT_LOG = (
    "id string, entity_type string, entity_base_type string, entity_id string, action int, occurred_on_utc timestamp_ntz, "
    "user_id string, user_display string, user_type string, tenant_id string, correlation_id string, diff string, snapshot string, "
    "error string, entry_hash string, previous_hash string, hash_key_id int, chain_sequence long"
)
COLUMNS = tuple(c.split()[0] for c in AUDIT_LOG.split(", "))
#: A stream is the history of one entity of one tenant; no tenant and '' are one.
STREAM = ("entity_type", "entity_id", "tenant")


class HistoryError(Exception):
    """A history that can't be replayed, or a request that can't be answered."""


def tenant(c: str | Column = "tenant_id") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def action_name(c: str | Column = "action") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*map(F.lit, ACTIONS)), c.cast("int") + 1)


def iso(c: str | Column) -> Column:
    """Round-trip text of an instant: seven digits and Z."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
