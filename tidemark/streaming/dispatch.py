"""The capture queue as a stream: entries become audit rows, failures are retried and
then given up, events are published, and lag is observed.

Offsets in the checkpoint take the place of claims and leases; a batch that fails is
replayed under the same number, and its rows are written to a folder of that number,
so a replay overwrites instead of repeating. One query writes a log (the chain needs a single writer).
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import canonical as cn
from ..operators import integrity, metrics
from ..operators.importer import nested_diff
from ..operators.view import to_event
from ..schema import COLUMNS, DELETED, SOFT_DELETED, STREAM, tenant
from ..sources.shared import Files
from .anchors import AnchorLog
from .cadence import Policy, started, with_snapshot_due
from .outbox import Outbox

QUEUE = (
    "id string, entity_type string, entity_base_type string, entity_id string, action int, before_json string, after_json string, occurred_on_utc timestamp_ntz, "
    "user_id string, user_display string, user_type string, tenant_id string, correlation_id string, attempts int, error string, custom_columns_json string"
)
MAX_ATTEMPTS = 5
#: A file of entries that come back holds about so much.
RETRY_FILE_BYTES = 32 << 20
log_of_faults = logging.getLogger(__name__)


@dataclass
class Dispatcher:
    """source: folder of queue files. Each batch writes log/batch=<n>, dead/batch=<n>
    (entries that failed MAX_ATTEMPTS times) and retry/batch=<n> (the others that
    failed, with one attempt more; ``redeliver`` feeds them back)."""

    spark: SparkSession
    source: str
    out: str
    publish: Callable[[DataFrame, int], None] | None = None
    custom_schema: str | None = None
    key: tuple[int, bytes] | None = None
    max_files: int = 500
    slo_seconds: float = 30.0
    #: Which error-free updates of a history keep the state after them as their snapshot.
    policy: Policy | None = None
    #: Called on the executors for each event, which is kept until it was taken.
    handler: Callable[[dict], None] | None = None
    #: Called with (batch, rows written, rows failed) once a batch is written.
    observers: list[Callable[[int, int, int], None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.anchor_log = AnchorLog(self.spark, f"{self.out}/anchors")
        self.outbox = Outbox(self.spark, f"{self.out}/outbox", self.handler) if self.handler else None

    def built(self, entries: DataFrame) -> DataFrame:
        """Queue entries as audit rows with _failed and the entries' own columns."""
        rows = entries.where("error is null").withColumn("_d", nested_diff(F.col("before_json"), F.col("after_json")))
        custom, told = [], []
        if self.custom_schema:  # unknown properties are ignored, missing ones are null, and bad ones are told of
            rows = rows.withColumn("_c", F.from_json("custom_columns_json", self.custom_schema))
            for f in rows.schema["_c"].dataType.fields:
                raw = F.get_json_object("custom_columns_json", f"$['{f.name}']")
                custom.append(F.col("_c").getField(f.name).alias(f.name))
                told.append(F.when(raw.isNotNull() & ~raw.rlike(r"^\s*[\[{]") & F.col("_c").getField(f.name).isNull(), f"AddColumn '{f.name}': dispatch deserialize failed"))
        # a record's state stays with its end: before a deletion, after a soft one
        kept_state = F.when(F.col("action") == DELETED, F.col("before_json")).when(F.col("action") == SOFT_DELETED, F.col("after_json"))
        fixed = {"diff": F.col("_d.diff"), "error": F.nullif(F.concat_ws("; ", F.col("_d.error"), *told), F.lit("")), "snapshot": kept_state}
        made = [(fixed[c] if c in fixed else F.col(c) if c in entries.columns else F.lit(None)).cast({"hash_key_id": "int", "chain_sequence": "long"}.get(c, "string") if c not in ("action", "occurred_on_utc") else {"action": "int", "occurred_on_utc": "timestamp_ntz"}[c]).alias(c) for c in COLUMNS]
        kept = [F.struct(*[c for c in entries.columns]).alias("_entry"), F.col("_d.error").isNotNull().alias("_failed")]
        return rows.select(*made, *custom, *kept)

    def batch(self, built: DataFrame, number: int) -> None:
        """A micro-batch of built rows, with snapshot_due where there is a policy."""
        at = f"{self.out}/built/batch={number}"
        built.write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema(built.schema).parquet(at)
        failed = rows.where("_failed").select("_entry.*", F.col("error").alias("_reason")).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
        failed.where(F.col("attempts") < MAX_ATTEMPTS).drop("_reason").write.mode("overwrite").parquet(f"{self.out}/retry/batch={number}")
        failed.where(F.col("attempts") >= MAX_ATTEMPTS).withColumn("error", F.col("_reason")).drop("_reason").write.mode("overwrite").parquet(f"{self.out}/dead/batch={number}")
        log = rows.where("not _failed")
        if self.policy:
            log = log.withColumn("snapshot", F.when(F.col("snapshot_due"), F.col("_entry.after_json")).otherwise(F.col("snapshot"))).drop("snapshot_due")
        log = log.drop("_entry", "_failed")
        if self.key:
            streams = log.select(*STREAM[:2], tenant().alias("tenant")).distinct()
            self.anchor_log.fold(number - 1)
            anchors = self.anchor_log.read(number - 1, streams)
            log = integrity.stamp(log, anchors, *self.key, custom=cn.custom_texts(log, [c for c in log.columns if c not in COLUMNS]))
        log.write.mode("overwrite").parquet(f"{self.out}/log/batch={number}")
        written = self.spark.read.schema(log.schema).parquet(f"{self.out}/log/batch={number}")
        if self.key:
            self.anchor_log.append(integrity.advanced_anchors(anchors, written), number)
        # events go out before the batch is committed: at least once, and subscribers drop ids they know
        if self.outbox:
            self.outbox.put(to_event(written), number)
            self.outbox.deliver()
        if self.publish:
            self.publish(to_event(written), number)
        for tell in self.observers:
            try:
                tell(number, written.count(), failed.count())
            except Exception:  # noqa: BLE001  an observer's fault must not fail what is written
                log_of_faults.exception("an observer failed in batch %s", number)

    def anchors(self, number: int) -> DataFrame:
        """The anchors after a batch."""
        return self.anchor_log.read(number)

    def start(self, *, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
        """Runs until stopped, or (once) until what is there now is done."""
        stream = self.spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", self.max_files).parquet(self.source)
        lag = F.greatest(F.lit(0.0), F.unix_micros(F.current_timestamp()) / 1e6 - F.unix_micros(F.col("occurred_on_utc").cast("timestamp")) / 1e6)
        stream = stream.observe("dispatch", F.count(F.lit(1)).alias("entries"), F.max(lag).alias("max_lag_seconds"), F.count_if(lag > self.slo_seconds).alias("late"), *self.histograms(lag))
        built = self.built(stream)
        built = with_snapshot_due(built, self.policy) if self.policy else built
        writer = built.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.out}/checkpoint")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
        return started(writer, self.spark) if self.policy else writer.start()

    @staticmethod
    def histograms(lag: Column) -> list[Column]:
        """Bucketed counts of lag, image bytes and attempts, for metrics.DispatchMetrics."""
        size = F.coalesce(F.octet_length("before_json"), F.lit(0)) + F.coalesce(F.octet_length("after_json"), F.lit(0))
        return [*metrics.observed("lag_bucket", lag, metrics.LAG_SECONDS), *metrics.observed("size_bucket", size, metrics.SIZE_BYTES), *metrics.observed("attempts_bucket", F.coalesce("attempts", F.lit(0)), metrics.ATTEMPTS)]

    def flush(self) -> None:
        self.start(once=True).awaitTermination()

    def redeliver(self) -> int:
        """Feeds failed entries back to the queue, those of each batch once, however often
        it is called, earlier batches first. Small batches come in together, so the queue
        gets files by the size of what failed, not by how many tasks and batches it failed
        in. Returns the number of entries."""
        fs, came = Files(self.spark, self.out), 0
        for name, batches in self._deliveries():
            at = [f"{self.out}/retry/batch={n}" for n in batches]
            files = max(1, -(-sum(map(fs.size, at)) // RETRY_FILE_BYTES))
            came += enqueue(self.spark.read.schema(QUEUE).parquet(*at).coalesce(files), self.source, name)
        return came

    def _deliveries(self) -> list[tuple[str, list[int]]]:
        """Names and batches of what isn't yet in the queue: what a call that was cut short
        has begun, then the batches since, as many in a row as fit into a file."""
        fs, queue, aside = Files(self.spark, self.out), Files(self.spark, self.source), f"{self.source.rstrip('/')}-aside"
        failed = [n for n in fs.numbers(f"{self.out}/retry", "batch=") if fs.written(f"{self.out}/retry/batch={n}")]
        begun = [(m[0], int(m[1]), int(m[2] or m[1])) for n in queue.names(aside) if (m := re.fullmatch(r"retry-(\d{10})(?:-(\d{10}))?", n))]
        out = [(name, [n for n in failed if lo <= n <= hi]) for name, lo, hi in begun if not queue.exists(f"{aside}/{name}/_moved")]
        groups, room = [], 0
        for n in failed:
            if n > max((hi for _, _, hi in begun), default=-1):
                if (size := fs.size(f"{self.out}/retry/batch={n}")) > room:
                    groups.append([])
                    room = RETRY_FILE_BYTES
                groups[-1].append(n)
                room -= size
        return out + [(f"retry-{g[0]:010d}-{g[-1]:010d}", g) for g in groups]

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/log").drop("batch")

    def dead(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/dead").drop("batch")


def enqueue(entries: DataFrame, source: str, name: str) -> int:
    """Puts entries into a queue's folder under a name, once: they are written aside, and
    each whole file then moves in, so that a stream never sees half of one. A call that
    was cut short is made again with the same name; after one that wasn't, nothing
    happens. Returns the number of entries that came in by this call."""
    spark = entries.sparkSession
    fs, aside = Files(spark, source), f"{source.rstrip('/')}-aside/{name}"
    if fs.exists(f"{aside}/_moved"):
        return 0
    if not fs.written(aside):
        columns = [F.col(c.split()[0]).cast(c.split()[1]) if c.split()[0] in entries.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in QUEUE.split(", ")]
        entries.select(*columns).write.mode("overwrite").parquet(aside)
        fs.touch(f"{aside}/_entries={spark.read.parquet(aside).count()}")
    fs.make(source)
    for part in fs.names(aside):
        if part.startswith("part-"):
            fs.rename(f"{aside}/{part}", f"{source}/{name}-{part.split('-')[1]}.parquet")
    fs.touch(f"{aside}/_moved")
    return sum(fs.numbers(aside, "_entries="))


def lag(entries: DataFrame, now, slo_seconds: float) -> DataFrame:
    """Per entry: lag in seconds (never negative) and whether it breaks the objective."""
    seconds = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("occurred_on_utc"), F.lit(now).cast("timestamp_ntz")))
    return entries.select("id", seconds.alias("lag_seconds"), (seconds > slo_seconds).alias("late"))
