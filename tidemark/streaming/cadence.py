"""Snapshot policies as keyed streaming state.

Each history (entity type, entity, tenant) has one value of state: the updates since its
last snapshot and that snapshot's time. A micro-batch touches the state of the histories
it has rows of, and no others; the checkpoint keeps state and offsets together, so a batch
that is replayed counts nothing twice, and a restart goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.capture import Every, EveryDuration, Policy  # noqa: F401
from ..schema import STREAM, UPDATED, tenant

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_EPOCH = dt.datetime(1970, 1, 1)


class _Cursor(StatefulProcessor):
    def __init__(self, policy: Policy, columns: list[str]):
        self.policy, self.columns = policy, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "since long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        # each call on the state is a round trip: none for a history without updates that count
        cursor, made = None, Row(*self.columns, "snapshot_due")
        for row in sorted(rows, key=lambda r: (r.occurred_on_utc, r.id)):
            due = False
            if row.action == UPDATED and row.error is None:
                since, last = cursor or self.cursor.get() or (0, None)
                now = (row.occurred_on_utc - _EPOCH) // dt.timedelta(microseconds=1)
                since += 1
                if due := self.policy.due(since, last, now):
                    since, last = 0, now
                cursor = (since, last)
            yield made(*(row[c] for c in self.columns), due)
        if cursor:
            self.cursor.update(cursor)

    def close(self) -> None:
        pass


def with_snapshot_due(stream: DataFrame, policy: Policy) -> DataFrame:
    """A stream of audit rows with snapshot_due; within a micro-batch a history's rows go by
    time and id. Of a history, a task holds the rows of one micro-batch."""
    columns = stream.columns
    out = StructType([*stream.schema.fields, StructField("snapshot_due", BooleanType())])
    keyed = stream.withColumn("_tenant", tenant()).groupBy(*STREAM[:2], "_tenant")
    return keyed.transformWithState(_Cursor(policy, columns), out, "Append", "None")


def started(writer, spark) -> StreamingQuery:
    """Starts a query that keeps keyed state, of which a batch stores its changes only, and
    without disk taken ahead for each partition; the session's own settings stay as they were."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def snapshot_cadence(stream: DataFrame, policy: Policy, out: str) -> StreamingQuery:
    """Writes (id, snapshot_due) of a stream of audit rows, whose micro-batches follow each
    other in time, to due/batch=<n>; a replayed batch overwrites what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.select("id", F.col("snapshot_due")).write.mode("overwrite").parquet(f"{out}/due/batch={number}")

    needed = stream.select("id", "entity_type", "entity_id", "tenant_id", "action", "occurred_on_utc", "error")
    writer = with_snapshot_due(needed, policy).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint")
    return started(writer.trigger(availableNow=True), stream.sparkSession)
