"""Counters and histograms of dispatching, summed over batches."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener


class DispatchMetrics(StreamingQueryListener):
    """Sums what ``observe`` tells of each batch of the dispatchers of a session; maxima stay
    maxima. Add it with ``spark.streams.addListener``. A batch that is told of again (after
    a restart) counts once."""

    def __init__(self, name: str = "dispatch"):
        self.name, self.sums, self.most = name, Counter(), {}
        self._seen: dict[tuple[str, int], bool] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is None or not row["entries"]:
            return
        with self._lock:
            if self._seen.setdefault((str(progress.id), progress.batchId), False):
                return
            self._seen[str(progress.id), progress.batchId] = True
            for key, value in row.asDict().items():
                if key.startswith("max_"):
                    self.most[key] = value if self.most.get(key) is None else max(self.most[key], value or 0)
                else:
                    self.sums[key] += value or 0
            self.sums["batches"] += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def histogram(self, name: str) -> list[int]:
        """Counts of a histogram's buckets."""
        with self._lock:
            found = {int(k.rsplit("_", 1)[1]): v for k, v in self.sums.items() if k.rsplit("_", 1)[0] == name and k.rsplit("_", 1)[1].isdigit()}
        return [found[k] for k in sorted(found)]
