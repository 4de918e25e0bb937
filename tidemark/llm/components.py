"""Connected components of a link table by alternating large and small stars.

A node's smallest neighbour comes from a partially aggregated groupBy and is
joined back, so no node's neighbours are ever gathered in one place. Each round is
written to the shared folder, which cuts its lineage. The rounds end when the edges
are stars: each node has one edge to a smaller one, and no node has one both ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, scratch, small_enough, stored


#: Edges (16 bytes each) up to which a round is worked in one partition, as small tables are broadcast: a round
#: then has no exchange, where one of a larger table has several, each with all of its partitions.
SMALL_EDGES = 100_000


def _large_star(edges: DataFrame, small: bool = False) -> DataFrame:
    both = edges.select(F.expr("stack(2, a, b, b, a) AS (u, v)"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(F.broadcast(least) if small else least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, small: bool = False) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(F.broadcast(least) if small else least, "u").select(F.expr("stack(2, v, m, u, m) AS (a, b)")).where("a != b")
    return (moved.coalesce(1) if small else moved).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node either is a root or has one edge only, to a root."""
    ends = edges.select(F.expr("stack(2, a, 1, 0, b, 0, 1) AS (node, down, up)"))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where((F.col("down") > 1) | (F.col("down") == 1) & (F.col("up") == 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one comparable type, no nulls. Returns (node, root): every
    node of an edge but the roots themselves, root being its component's least node."""
    spark = edges.sparkSession
    old = scratch(spark)

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), old)
    while True:
        small = small_enough(now, SMALL_EDGES)
        now = now.coalesce(1) if small else now
        if _stars(now):
            break
        at = scratch(spark)
        now = stored(_small_star(_large_star(now, small), small), at)
        drop_folder(spark, old)
        old = at
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
