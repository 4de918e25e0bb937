"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest number of rows of ids (16 bytes each) that is broadcast by hint: 64 MB.
BROADCAST_ROWS = 4_000_000
#: Spark's own bound of a batch that goes to a Python worker is 10,000 rows, some 20 MB of texts, and JVM and worker
#: both hold several. Operators work on slices of half a megabyte anyway. A session that sets its own bound keeps it.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(query: Callable) -> Callable:
    """The query or stage, with texts going to Python in batches of BATCH_BYTES; they go when the result is written, so the setting stays."""

    @wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        if spark.conf.get(BATCH_BYTES[0], None) is None:
            spark.conf.set(*BATCH_BYTES)
        return query(spark, *rest)

    return run


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or,
    where that is unset (tests), below a local temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    at = at or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_folder(spark: SparkSession, at: str) -> None:
    """Deletes a folder that scratch() named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of narrow rows has few enough of them to be broadcast."""
    return df.count() <= rows


def named(columns) -> list[Column]:
    """Columns by their names as they are, dots and spaces included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(name: str, columns: list[str]) -> str:
    """A column name that no column of a table has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids; ids travel by broadcast only below BROADCAST_ROWS."""
    return df.join(F.broadcast(ids) if small_enough(ids) else ids, key, "left_semi")


_last: list = [None, None]


def once(value, build: Callable):
    """build(value), made once in a Python worker for a broadcast's value, not in each task."""
    if _last[0] is not value:
        _last[:] = value, build(value)
    return _last[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


Query = Callable[[SparkSession, str], DataFrame]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents that aren't held
    out: those whose ids come first by a hash, and of rows that share an id, the one whose
    text comes first by a hash. Labels that are neither 0 nor 1, and ids with both labels, are left out. Only ids that documents hold are chosen (texts
    aren't read for that), and they are few enough to be broadcast."""
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    )
    there = documents.select("doc_id")
    if small_enough(usable):
        there = there.join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi").distinct()
    known = usable.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
