"""The anchors of chained streams as a log of changes.

A batch appends the anchors of the streams that it stamped, as a run of its own. Reading
merges the runs: of each stream the newest anchor counts. When ``FAN`` runs of a size lie
side by side they are merged into one, so that a stream is rewritten once for each power
of FAN batches, and a read opens few runs. Batches that may yet be replayed aren't merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import ANCHOR
from ..schema import STREAM
from ..sources.shared import Files

FAN = 8
_COLUMNS = tuple(c.split()[0] for c in ANCHOR.split(", "))


class AnchorLog:
    def __init__(self, spark: SparkSession, at: str, fan: int = FAN):
        self.spark, self.at, self.fan = spark, at, fan
        self.files = Files(spark, at)

    def _name(self, run: tuple[int, int]) -> str:
        return f"{self.at}/run-{run[0]:010d}-{run[1]:010d}"

    def _all(self) -> list[tuple[int, int]]:
        found = [tuple(map(int, n.split("-")[1:])) for n in self.files.names(self.at) if n.startswith("run-")]
        return sorted(r for r in found if self.files.written(self._name(r)))

    def runs(self, upto: int) -> list[tuple[int, int]]:
        """The live runs of the batches up to one: those that no larger run holds."""
        there = [r for r in self._all() if r[1] <= upto]
        return [r for r in there if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in there)]

    def read(self, upto: int, streams: DataFrame | None = None) -> DataFrame:
        """The anchors after a batch; of ``streams`` (entity_type, entity_id, tenant) only, if given."""
        if not (live := self.runs(upto)):
            return self.spark.createDataFrame([], ANCHOR)
        rows = self.spark.read.schema(f"{ANCHOR}, as_of long").parquet(*map(self._name, live))
        if streams is not None:
            rows = rows.join(streams, list(STREAM), "left_semi")
        return self._newest(rows).select(*_COLUMNS)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in (*_COLUMNS, "as_of") if c not in STREAM]
        return rows.groupBy(*STREAM).agg(F.max_by(F.struct(*rest), "as_of").alias("_n")).select(*STREAM, "_n.*")

    def append(self, changed: DataFrame, number: int) -> None:
        """A batch's changed anchors; a replay overwrites them."""
        changed.select(*_COLUMNS, F.lit(number).cast("long").alias("as_of")).write.mode("overwrite").parquet(self._name((number, number)))

    def fold(self, upto: int) -> list[tuple[int, int]]:
        """Merges what is due among the batches up to one, all of which are committed.
        Runs that were merged by an earlier call go now: nothing reads them any more."""
        live = self.runs(upto)
        for r in self._all():
            if r[1] <= upto and r not in live:
                self.files.delete(self._name(r))
        made = []
        while merged := self._due(live):
            one = (merged[0][0], merged[-1][1])
            rows = self.spark.read.schema(f"{ANCHOR}, as_of long").parquet(*map(self._name, merged))
            self._newest(rows).select(*_COLUMNS, "as_of").write.mode("overwrite").parquet(self._name(one))
            live = sorted([r for r in live if r not in merged] + [one])
            made.append(one)
        return made

    def _due(self, live: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """FAN runs side by side of one size class, the newest first, if there are any."""
        for k in range(len(live) - self.fan, -1, -1):
            some = live[k : k + self.fan]
            if len({self._class(r) for r in some}) == 1:
                return some
        return []

    def _class(self, run: tuple[int, int]) -> int:
        size, out = run[1] - run[0] + 1, 0
        while size >= self.fan:
            size, out = size // self.fan, out + 1
        return out
