"""An index of changed paths: which of a log's files hold a change at or below a path.

For each file, every path of its diffs and each of a path's beginnings is listed once, in a
table that is sorted by path, so a look-up reads a few row groups. The files it names are
read, and the text test decides on their rows. Files that the index doesn't know (they
were written by others) are read too: the index saves work and never decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import VERBS
from ..sources.shared import Files
from . import filters as f

_OPERATION = '"op":"(?:' + "|".join(VERBS) + r')","path":"((?:[^"\\]|\\.)*)"'


def prefixes(diff: Column) -> Column:
    """array<string>: the paths of a diff's operations, as they are written, and their beginnings; '' for every diff."""
    parts = lambda p: F.split(p, "/")
    beginnings = lambda p: F.transform(F.sequence(F.lit(1), F.size(parts(p))), lambda n: F.array_join(F.slice(parts(p), F.lit(1), n), "/"))
    paths = F.coalesce(F.regexp_extract_all(diff, F.lit(_OPERATION), 1), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.array_distinct(paths), beginnings))))


class IndexedLog:
    """A log's files in at/log and their paths in at/paths."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        self.files = Files(spark, at)

    def append(self, rows: DataFrame) -> None:
        """Writes rows, then what they change. Cut short between the two, their files aren't in the index, and are read always."""
        before = set(self.names())
        rows.write.mode("append").parquet(f"{self.at}/log")
        if new := [n for n in self.names() if n not in before]:
            written = self._read(rows.schema, new).select(F.col("_metadata.file_name").alias("file"), F.explode(prefixes(F.col("diff"))).alias("path"))
            written.distinct().repartitionByRange("path", "file").sortWithinPartitions("path", "file").write.parquet(f"{self.at}/paths/write-{uuid.uuid4().hex}")

    def names(self) -> list[str]:
        return [n for n in self.files.names(f"{self.at}/log") if n.endswith(".parquet")]

    def _read(self, schema, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.at}/log/{n}" for n in names])

    def _indexed(self, path: str) -> set[str]:
        """Files that hold a path."""
        writes = [f"{self.at}/paths/{n}" for n in self.files.names(f"{self.at}/paths") if self.files.written(f"{self.at}/paths/{n}")]
        if not writes:
            return set()
        found = self.spark.read.schema("file string, path string").parquet(*writes).where(F.col("path") == path)
        return {r["file"] for r in found.select("file").distinct().toLocalIterator()}  # names of files, which a reader's listing holds as well

    def candidates(self, pointer: str) -> list[str]:
        """The files that have to be read for a path."""
        held, known = self._indexed(f.escaped_pointer(pointer)), self._indexed("")
        return [n for n in self.names() if n in held or n not in known]

    def changed_path(self, pointer: str) -> DataFrame:
        """The rows that changed a path or something below it."""
        schema = self.spark.read.parquet(f"{self.at}/log").schema
        names = self.candidates(pointer)
        rows = self._read(schema, names) if names else self.spark.createDataFrame([], schema)
        return rows.transform(f.changed_path(pointer))
