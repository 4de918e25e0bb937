"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests), below a local temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    root = root or "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Writes a table and reads it back, which cuts its lineage."""
    at = at or folder(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Files:
    """File system calls on the folders that driver and executors share."""

    def __init__(self, spark: SparkSession, at: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def names(self, at: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(at))) if self.exists(at) else []

    def numbers(self, at: str, prefix: str) -> list[int]:
        return sorted(int(n[len(prefix) :]) for n in self.names(at) if n.startswith(prefix))

    def written(self, at: str) -> bool:
        """Whether a table's write was committed."""
        return self.exists(f"{at}/_SUCCESS")

    def size(self, at: str) -> int:
        return self._fs.getContentSummary(self._path(at)).getLength()

    def make(self, at: str) -> None:
        self._fs.mkdirs(self._path(at))

    def rename(self, at: str, to: str) -> None:
        if not self.exists(to) and not self._fs.rename(self._path(at), self._path(to)):
            raise OSError(f"{at} can't become {to}")

    def touch(self, at: str) -> None:
        self._fs.create(self._path(at), True).close()

    def delete(self, at: str) -> None:
        self._fs.delete(self._path(at), True)
