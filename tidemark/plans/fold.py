"""Folds over ordered groups in bounded memory.

Rows are dealt by key and sorted within partitions, and a fold walks them as they
stream by: it holds one state, never a group. (A grouped pandas function would
hold the whole history of a stream.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

Row = dict


def fold_sorted(df: DataFrame, keys: list[str], order: list[Column | str], start: Callable[[], object], step: Callable[[object, Row], Iterator[Row]], end: Callable[[object], Iterator[Row]], schema: str) -> DataFrame:
    """For each group of equal keys: start(), then step(state, row) for its rows in
    order, then end(state). Both yield result rows. State objects are changed in place."""
    from pyspark.sql.types import StructType

    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    if state is not None:
                        out.extend(end(state))
                    state, key = start(), own
                out.extend(step(state, row))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if state is not None:
            out.extend(end(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
