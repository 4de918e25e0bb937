"""Sharding: size-tiered compaction of immutable shards under a versioned
manifest, in built-in functions only.

``append`` writes each arrival as small shards, without a shuffle: a task deals its
own rows to as many shards as their bytes call for. ``compact`` looks at the live
shards by size tier (powers of ``fanout``); where a tier has at least ``fanout``
shards below half the target size, its shards are merged, in order of arrival,
into equal shards of at most about ``target_bytes``, with one shuffle of just these
rows. Old shards stay until ``vacuum``, so readers of older versions go on.

A version is a manifest (one row for each live shard) that is written aside and
then committed by creating the file ``commits/<version>`` with a rename that fails
where the name is taken (atomic on HDFS and on object stores with such a
precondition): of two writers one wins, and the other's files are never read.
Rows are read through the manifest only, so what a lost executor or a failed job
left behind is invisible.

Rows are stored as one struct column, so no column name can clash with the
store's own. Null texts count 0 bytes, a very long text may make a shard larger than
its target, since a row is never cut, and a null arrival comes before all others. An
empty arrival commits no shard; an empty store reads as no rows of the given schema.
Repeated rows are kept, each of them; shards of one size merge in order of their runs
and numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, unused

SMALL_BYTES, TARGET_BYTES, FANOUT = 8 << 20, 128 << 20, 4
#: The size of tier 0.
TIER_BYTES = 256 << 10
#: Bits of a shard's number: 40 below the arrival's (of at most 2^22), 16 below the task's (of at most 2^24; a task has at most 2^16 shards).
_ARRIVAL_AT, _TASK_AT = 40, 16
_MANIFEST = "run string, shard long, arrival long, rows long, bytes long"


class Conflict(Exception):
    """Another writer has committed the version meanwhile."""


class ShardStore:
    def __init__(self, spark: SparkSession, at: str, *, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.at = spark, at.rstrip("/")
        self.small_bytes, self.target_bytes, self.fanout = small_bytes, target_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.at).toUri(), spark._jsc.hadoopConfiguration())
        self._system = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())
        self._none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE

    # manifests

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        folder = self._path(f"{self.at}/commits")
        if not self._system.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._system.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards: run, shard, arrival, rows, bytes."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        name = self.spark.read.text(f"{self.at}/commits/{version:010d}").first()[0]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.at}/manifests/{name}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        name = f"{version:010d}-{uuid.uuid4().hex}"
        manifest.select("run", "shard", "arrival", "rows", "bytes").coalesce(1).write.parquet(f"{self.at}/manifests/{name}")
        aside = self._path(f"{self.at}/aside/{name}")
        out = self._system.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        self._system.mkdirs(self._path(f"{self.at}/commits"))
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = self._none
        try:
            self._files.rename(aside, self._path(f"{self.at}/commits/{version:010d}"), renames)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self._system.exists(self._path(f"{self.at}/commits/{version:010d}")):
                raise Conflict(f"version {version}") from e
            raise
        return version

    # data

    def _folder(self, run: str) -> str:
        return f"{self.at}/data/run={run}"

    def _write(self, rows: DataFrame, run: str) -> None:
        """A run's shards, in a folder of its own, so that writers at the same time share no temporary files."""
        rows.write.mode("errorifexists").option("compression", "zstd").partitionBy("shard").parquet(self._folder(run))

    def _data(self, runs: list[str]) -> DataFrame | None:
        """Rows of these runs; other folders aren't listed. None if none of them has a shard."""
        there = [self._folder(r) for r in runs if any(s.isDirectory() for s in self._system.listStatus(self._path(self._folder(r))))]
        return self.spark.read.option("basePath", f"{self.at}/data").schema(self._schema()).parquet(*there) if there else None

    def _schema(self) -> str:
        kinds = self.spark.read.parquet(f"{self.at}/schema").schema["row"].dataType.simpleString()
        return f"bytes long, row {kinds}, run string, shard long"

    def _live(self, shards: DataFrame) -> DataFrame | None:
        """Rows of the given shards. Runs are few (one for each commit that still has
        shards), and only their folders are read; shards are joined, by broadcast only if small."""
        rows = self._data([r[0] for r in shards.select("run").distinct().collect()])
        return None if rows is None else rows.join(shards, ["run", "shard"])

    def read(self, version: int | None = None, *, with_shard: str | None = None) -> DataFrame:
        """The rows of a version; with_shard names a column to add, ``<commit>/<number>`` of the row's shard."""
        rows = self._live(self.manifest(version).select("run", "shard"))
        if rows is None:
            return self.spark.read.parquet(f"{self.at}/schema").select("row.*", *([F.lit("").alias(with_shard)] if with_shard else []))
        name = F.concat_ws("/", F.substring_index("run", "-", 1), F.col("shard").cast("string"))
        return rows.select("row.*", *([name.alias(with_shard)] if with_shard else []))

    def append(self, rows: DataFrame, *, text: str = "text", arrival: Column | None = None) -> int:
        """Commits the rows as small shards and returns the version. With ``arrival`` (a
        column of whole numbers) each number is an arrival of its own and shares no shard with others."""
        version = self.version() + 1
        run = f"{version:010d}-{uuid.uuid4().hex[:12]}"
        packed = rows.select(
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
            F.spark_partition_id().cast("long").alias("task"), F.monotonically_increasing_id().alias("place"), (arrival if arrival is not None else F.lit(0)).cast("long").alias("arrival"),
        )
        if not self._system.exists(self._path(f"{self.at}/schema/_SUCCESS")):
            packed.select("row").limit(0).write.mode("overwrite").parquet(f"{self.at}/schema")
        per_task = packed.groupBy("task").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
        split = max(1, -(-(per_task or 0) // self.small_bytes))
        # within a run, a shard's number is its arrival, then its task, then its part of the task's rows
        parts = F.shiftleft(F.coalesce("arrival", F.lit(-1)) + 1, _ARRIVAL_AT) + F.shiftleft(F.col("task"), _TASK_AT) + F.pmod("place", F.lit(split))
        self._write(packed.select("bytes", "row", parts.alias("shard")), run)
        new = self._data([run])
        if new is None:
            return self._commit(self.manifest(version - 1), version)
        counted = new.groupBy("run", "shard").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
        counted = counted.withColumn("arrival", F.shiftleft(F.lit(version).cast("long"), 63 - _ARRIVAL_AT) + F.shiftright("shard", _ARRIVAL_AT))
        return self._commit(self.manifest(version - 1).unionByName(counted), version)

    def plan(self, version: int | None = None) -> DataFrame:
        """Shards to merge and the number (``target``) of the shard each goes to."""
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(F.col("bytes"), F.lit(1)) / F.lit(TIER_BYTES)))).alias("tier")
        small = self.manifest(version).where(F.col("bytes") * 2 < self.target_bytes).select("*", tier)
        # places in order of arrival: within an arrival, and arrivals before it
        by_arrival = small.groupBy("tier", "arrival").agg(F.sum("bytes").alias("sum"), F.count("*").alias("n"))
        earlier = Window.partitionBy("tier").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("tier")
        by_arrival = by_arrival.select("tier", "arrival", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"), F.sum("sum").over(whole).alias("all"), F.sum("n").over(whole).alias("count"))
        inside = Window.partitionBy("tier", "arrival").orderBy("run", "shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = small.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(by_arrival.where(F.col("count") >= self.fanout), ["tier", "arrival"])
        wanted = F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(self.target_bytes)))
        middle = F.col("base") + F.col("before") + F.col("bytes") / 2
        number = F.least(F.floor(middle * wanted / F.greatest(F.col("all"), F.lit(1))), wanted - 1)
        return placed.select("run", "shard", "arrival", (F.col("tier") * 10_000_000 + number).cast("long").alias("target"))

    def compact(self) -> int | None:
        """Merges what is due and commits; None if nothing is."""
        before = self.version()
        plan = self.plan(before)
        if not plan.limit(1).count():
            return None
        version, old = before + 1, self.manifest(before)
        run = f"{version:010d}-{uuid.uuid4().hex[:12]}"
        moved = self._live(plan.drop("arrival")).select("bytes", "row", F.col("target").alias("shard"))
        self._write(moved.repartition("shard"), run)
        counted = self._data([run]).groupBy("run", "shard").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
        first = plan.groupBy(F.col("target").alias("shard")).agg(F.min("arrival").alias("arrival"))
        return self._commit(old.join(plan.select("run", "shard"), ["run", "shard"], "left_anti").unionByName(counted.join(first, "shard")), version)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes runs that none of the last ``keep`` versions needs; returns how many. Runs
        of versions that aren't committed yet stay: their writers may be at work."""
        last = self.version()
        live = {r[0] for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v).select("run").distinct().collect()}
        gone = [s.getPath() for s in self._system.listStatus(self._path(f"{self.at}/data")) if s.getPath().getName().startswith("run=") and int(s.getPath().getName()[4:].split("-")[0]) <= last and s.getPath().getName()[4:] not in live]
        for path in gone:
            self._system.delete(path, True)
        return len(gone)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in seven lots, each twice as large as the one before; they are
    appended and compacted until nothing is due, and read back from the last version."""
    store = ShardStore(spark, scratch(spark))
    documents = table(spark, sf_dir, "documents")
    lot = F.floor(F.log2(F.pmod(F.xxhash64("doc_id"), F.lit(127)) + 1))
    store.append(documents, arrival=lot)
    while store.compact() is not None:
        pass
    shard = unused("shard", documents.columns)
    rows = store.read(with_shard=shard)
    return rows.select("doc_id", F.col(shard).alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
