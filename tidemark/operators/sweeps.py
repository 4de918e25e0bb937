"""Sweeps that stop at a deadline and go on where they stopped.

What a sweep does is decided once and stored in slices of a defined order. The clock is read
before each slice; a slice that is done leaves a mark, and the next call begins behind the
last mark. A slice that was cut short is done again as a whole, so what it does has to
overwrite, not append (``archive_to``).
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STREAM, HistoryError, tenant
from ..sources.shared import Files, stored
from . import compaction
from .integrity import prunable, pruned_anchors
from .retention import MAX_ROWS_PER_SWEEP, Policy, expired

Clock = Callable[[], float]


@dataclass(frozen=True)
class Progress:
    """taken: rows (of a compaction: rows folded away) by this call; done and slices: by all calls so far."""

    taken: int
    done: int
    slices: int

    @property
    def finished(self) -> bool:
        return self.done == self.slices


class Slices:
    """at: a sweep's own folder. Work is dealt by ranges of ``order``, or all rows of a
    ``together`` into one slice."""

    def __init__(self, spark: SparkSession, at: str, clock: Clock = time.monotonic):
        self.spark, self.at, self.clock = spark, at, clock
        self.files = Files(spark, at)

    def planned(self) -> bool:
        return self.files.written(f"{self.at}/work")

    def plan(self, work: DataFrame, slices: int, order: list[Column | str] | None = None, together: list[str] | None = None) -> None:
        if order:
            bounds = stored(work.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()))
        else:
            bounds = work.withColumn("slice", F.pmod(F.xxhash64(*together), F.lit(slices)).cast("int"))
        bounds.write.partitionBy("slice").mode("overwrite").parquet(f"{self.at}/work")

    def all(self) -> list[int]:
        return self.files.numbers(f"{self.at}/work", "slice=")

    def done(self) -> list[int]:
        return self.files.numbers(f"{self.at}/done", "slice=")

    def rows(self, slices: list[int]) -> DataFrame:
        work = self.spark.read.parquet(f"{self.at}/work")
        return work.where(F.col("slice").isin(*slices)).drop("slice") if slices else work.where("false").drop("slice")

    def run(self, take: Callable[[DataFrame, int], int], budget: dt.timedelta | None) -> Progress:
        """take(rows, slice) does a slice and returns what it counts."""
        until = None if budget is None else self.clock() + budget.total_seconds()
        done, taken = set(self.done()), 0
        for k in self.all():
            if k in done:
                continue
            if until is not None and self.clock() >= until:
                break
            taken += take(self.rows([k]), k)
            self.files.touch(f"{self.at}/done/slice={k}")
        return Progress(taken, len(self.done()), len(self.all()))


SliceArchiver = Callable[[DataFrame, int], None]


def archive_to(path: str, mapped: Callable[[DataFrame], DataFrame] = lambda df: df) -> SliceArchiver:
    """An archive with a folder for each slice, which a slice that is done again overwrites."""
    return lambda rows, k: mapped(rows).write.mode("overwrite").parquet(f"{path}/slice={k}")


@dataclass
class RetentionSweep:
    """Retention of a log in slices. ``run`` goes on until the budget is over, and ``log`` is
    what is left of a log after the slices done so far: the caller publishes it. Slices
    begin with the oldest rows; of a chained log (``anchors``), with whole streams, so that
    a sweep which stops leaves every chain whole."""

    spark: SparkSession
    at: str
    policy: Policy
    slices: int = 16
    max_rows: int | None = MAX_ROWS_PER_SWEEP
    archivers: tuple[SliceArchiver, ...] = ()
    clock: Clock = time.monotonic

    def __post_init__(self) -> None:
        self.work = Slices(self.spark, self.at, self.clock)

    def run(self, log: DataFrame, now: dt.datetime, budget: dt.timedelta | None = None, anchors: DataFrame | None = None) -> Progress:
        if not self.work.planned():
            victims = expired(log, self.policy, now, self.max_rows)
            if anchors is not None:
                self.work.plan(prunable(victims, anchors).withColumn("_tenant", tenant()), self.slices, together=[*STREAM[:2], "_tenant"])
            else:
                refuse_chained(victims)
                self.work.plan(victims.withColumn("_tenant", tenant()), self.slices, order=["occurred_on_utc", "id"])

        def take(rows: DataFrame, k: int) -> int:
            rows = rows.drop("_tenant")
            for archive in self.archivers:
                archive(rows, k)
            return rows.count()

        return self.work.run(take, budget)

    def removed(self) -> DataFrame:
        return self.work.rows(self.work.done()).drop("_tenant")

    def log(self, log: DataFrame) -> DataFrame:
        return log.join(self.removed().select("id"), "id", "left_anti").select(*log.columns)

    def anchors(self, anchors: DataFrame) -> DataFrame:
        return pruned_anchors(anchors, self.removed())


def refuse_chained(victims: DataFrame) -> None:
    """Raises if a sweep that knows no anchors would take rows of a chain."""
    if victims.where("entry_hash is not null").limit(1).count():
        raise HistoryError("rows of a chain go only with its anchors, else the chain reads as broken")


@dataclass
class CompactionSweep:
    """Compaction of the largest streams in slices, the largest first. A slice's folded
    streams lie in at/folded; ``log`` puts them in the place of what they were."""

    spark: SparkSession
    at: str
    min_rows: int = 200
    retain_tail: int = 50
    limit: int | None = 100
    slices: int = 16
    clock: Clock = time.monotonic

    def __post_init__(self) -> None:
        self.work = Slices(self.spark, self.at, self.clock)

    def run(self, log: DataFrame, budget: dt.timedelta | None = None) -> Progress:
        if not self.work.planned():
            chosen = compaction.candidates(log, self.min_rows, self.limit)
            self.work.plan(chosen.select(*STREAM, "total"), self.slices, order=[F.desc("total"), *STREAM])

        def take(streams: DataFrame, k: int) -> int:
            compaction.compact(self._of(log, streams, "left_semi"), self.retain_tail).write.mode("overwrite").parquet(f"{self.at}/folded/slice={k}")
            return streams.agg(F.coalesce(F.sum(F.greatest(F.col("total") - self.retain_tail - 1, F.lit(0))), F.lit(0))).first()[0]

        return self.work.run(take, budget)

    def _of(self, log: DataFrame, streams: DataFrame, how: str) -> DataFrame:
        return log.withColumn("tenant", tenant()).join(streams.select(*STREAM), list(STREAM), how).select(*log.columns)

    def log(self, log: DataFrame) -> DataFrame:
        """A log that only grew since the sweep began: rows that came meanwhile stay as they are."""
        if not (done := self.work.done()):
            return log
        streams = self.work.rows(done)
        folded = self.spark.read.schema(log.schema).parquet(*[f"{self.at}/folded/slice={k}" for k in done])
        return self._of(log, streams, "left_anti").unionByName(folded)
