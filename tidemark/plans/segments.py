"""Running values over ordered groups of which none has to fit in one task.

Rows are dealt by ranges of (group, order), so a large group lies in several ranges. Each
range is walked alone; what came before it in its group reaches it as one carried row. A
range has at most one group that began before it, so there is at most one carried row for
each range, however many rows and groups there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_SEG, _IDX = "_segment", "_index"


def running(df: DataFrame, keys: list[str], order: list[Column | str], *, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each row in its group's order: sums and maxima up to it, and the row
    before it. Nulls of a sum or maximum are passed over. order has to name every row of a
    group; of rows that are equal in it, any may come first."""
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    names = [*sums, *maxes, *lags]
    rows = df.withColumns(sums | maxes | lags).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(rows.withColumns({_SEG: F.spark_partition_id(), _IDX: F.monotonically_increasing_id()}))
    own = Window.partitionBy(*keys, _SEG).orderBy(_IDX)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    here = {n: F.sum(n).over(upto) for n in sums} | {n: F.max(n).over(upto) for n in maxes} | {n: F.lag(n).over(own) for n in lags}
    local = rows.withColumns({**{f"_own_{n}": v for n, v in here.items()}, "_first": F.row_number().over(own) == 1}).drop(*names)

    ends = rows.groupBy(*keys, _SEG).agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxes], *[F.max_by(F.struct(n), _IDX).getField(n).alias(n) for n in lags])
    segments = Window.partitionBy(*keys).orderBy(_SEG)
    before = segments.rowsBetween(Window.unboundedPreceding, -1)
    come = {n: F.sum(n).over(before) for n in sums} | {n: F.max(n).over(before) for n in maxes} | {n: F.lag(n).over(segments) for n in lags}
    carried = ends.withColumns({**{f"_come_{n}": v for n, v in come.items()}, "_place": F.row_number().over(segments)}).where("_place > 1")
    carried = carried.select(F.col(_SEG).alias("_seg2"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[f"_come_{n}" for n in names])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col(_SEG) == F.col("_seg2"))
    joined = local.join(F.broadcast(carried), same, "left")  # at most a row for each range
    made = {n: F.coalesce(F.col(f"_own_{n}") + F.col(f"_come_{n}"), f"_own_{n}", f"_come_{n}") for n in sums}
    made |= {n: F.greatest(f"_own_{n}", f"_come_{n}") for n in maxes}
    made |= {n: F.when(F.col("_first"), F.col(f"_come_{n}")).otherwise(F.col(f"_own_{n}")) for n in lags}
    return joined.select(*df.columns, *[v.alias(n) for n, v in made.items()])
