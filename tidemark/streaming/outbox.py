"""Events that wait until a handler has taken them.

A batch's events are stored under its number, so a replayed batch puts them there again
instead of twice. ``deliver`` hands each event that has no mark to the handler, on the
executors; a handler that fails for one event costs its neighbours nothing. Marks are
written when a round is over: a round that is cut short is made again, so an event can
come more than once, and its audit_log_id tells that it is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Files

MARK = "audit_log_id string, delivered boolean, error string"


class Outbox:
    """handler: called with an event as a dict, in a Python worker. After max_attempts
    failures an event is given up and stays in ``failed``."""

    def __init__(self, spark: SparkSession, at: str, handler: Callable[[dict], None], max_attempts: int = 3):
        self.spark, self.at, self.handler, self.max_attempts = spark, at, handler, max_attempts
        self.files = Files(spark, at)

    def put(self, events: DataFrame, number: int) -> None:
        events.write.mode("overwrite").parquet(f"{self.at}/events/batch={number}")

    def _marks(self) -> DataFrame:
        if not self.files.numbers(f"{self.at}/marks", "round="):
            return self.spark.createDataFrame([], f"{MARK}, round int")
        return self.spark.read.schema(f"{MARK}, round int").parquet(f"{self.at}/marks")

    def status(self) -> DataFrame:
        """(audit_log_id, delivered, attempts, error) of every event that was tried."""
        return self._marks().groupBy("audit_log_id").agg(F.bool_or("delivered").alias("delivered"), F.count("*").cast("int").alias("attempts"), F.max_by("error", "round").alias("error"))

    def failed(self) -> DataFrame:
        return self.status().where(~F.col("delivered") & (F.col("attempts") >= self.max_attempts))

    def _open(self) -> list[int]:
        """Batches that may have events to deliver."""
        done = set(self.files.numbers(f"{self.at}/done", "batch="))
        return [n for n in self.files.numbers(f"{self.at}/events", "batch=") if n not in done and self.files.written(f"{self.at}/events/batch={n}")]

    def deliver(self) -> tuple[int, int]:
        """One round: returns how many events were taken and how many failed."""
        if not (batches := self._open()):
            return 0, 0
        events = self.spark.read.parquet(*[f"{self.at}/events/batch={n}" for n in batches])
        over = self.status().where(F.col("delivered") | (F.col("attempts") >= self.max_attempts))
        pending = events.join(over, "audit_log_id", "left_anti")
        number = max(self.files.numbers(f"{self.at}/marks", "round="), default=-1) + 1
        at = f"{self.at}/marks/round={number}"
        pending.mapInArrow(_handled(self.handler), MARK).write.mode("overwrite").parquet(at)
        tried = self.spark.read.schema(MARK).parquet(at).groupBy("delivered").count().collect()
        taken, failed = (sum(r["count"] for r in tried if r["delivered"] == kind) for kind in (True, False))
        if not failed:  # what is left of these batches was taken or given up
            for n in batches:
                self.files.touch(f"{self.at}/done/batch={n}")
        return taken, failed


def _handled(handler: Callable[[dict], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                told = None
                try:
                    handler(event)
                except Exception as e:  # noqa: BLE001  a subscriber's fault, whatever it is, stays with its event
                    told = f"{type(e).__name__}: {e}"
                out.append({"audit_log_id": event["audit_log_id"], "delivered": told is None, "error": told})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("audit_log_id", pa.string()), ("delivered", pa.bool_()), ("error", pa.string())]))

    return run
