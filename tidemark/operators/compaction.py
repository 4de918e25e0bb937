"""Compaction: a stream's old rows are folded into one snapshot row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonpatch as jp
from ..plans.fold import fold_sorted
from ..schema import DELETED, EMPTY_DIFF, INSERTED, SOFT_DELETED, STREAM, UPDATED, HistoryError, tenant
from ..sources.shared import stored
from .aggregate import stream_sizes


def candidates(df: DataFrame, min_rows: int = 200, limit: int | None = 100) -> DataFrame:
    """Streams with more rows than min_rows and none chained, the largest first."""
    found = stream_sizes(df).where((F.col("total") > min_rows) & ~F.col("chained")).drop("chained")
    found = found.orderBy(F.desc("total"), "entity_type", "entity_id", "tenant")
    return found.limit(limit) if limit else found


def ranked(df: DataFrame, retain_tail: int) -> DataFrame:
    """Adds tenant, and fold: 'remove', 'boundary' or 'keep'."""
    if retain_tail < 0:
        raise ValueError("the tail can't be negative")
    stream = Window.partitionBy(*STREAM)
    place = F.row_number().over(stream.orderBy("occurred_on_utc", "id"))
    folded = F.count("*").over(stream) - retain_tail
    rows = df.withColumn("tenant", tenant()).withColumns({"_place": place, "_folded": folded})
    fold = F.when((F.col("_folded") < 2) | (F.col("_place") > F.col("_folded")), "keep").when(F.col("_place") == F.col("_folded"), "boundary").otherwise("remove")
    return rows.withColumn("fold", fold).drop("_place", "_folded")


def compact(df: DataFrame, retain_tail: int = 50, only: DataFrame | None = None) -> DataFrame:
    """The audit log after compaction of all streams, or of those in ``only``
    (entity_type, entity_id, tenant): the last folded row becomes an insert with the
    state as its snapshot (a deletion stays one), earlier ones are gone. Chained
    streams are left alone, since removing their rows would break the chain. A
    stream whose rows can't be replayed raises."""
    columns = df.columns
    rows = ranked(df, retain_tail)
    chained = F.max(F.col("entry_hash").isNotNull()).over(Window.partitionBy(*STREAM))
    rows = rows.withColumn("fold", F.when(chained, "keep").otherwise(F.col("fold")))
    if only is not None:
        rows = rows.join(only.select(*STREAM).distinct().withColumn("_chosen", F.lit(True)), list(STREAM), "left")
        rows = rows.withColumn("fold", F.when(F.col("_chosen"), F.col("fold")).otherwise("keep")).drop("_chosen")
    folded = rows.where("fold != 'keep'").select(*STREAM, "occurred_on_utc", "id", "action", "diff", "snapshot", "fold")
    states = fold_sorted(folded, list(STREAM), ["occurred_on_utc", "id"], lambda: {"doc": {}}, _step, lambda state: iter(()), "id string, state string").withColumnRenamed("id", "_id")
    kept = rows.where("fold != 'remove'").join(states, (F.col("id") == F.col("_id")) & (F.col("fold") == "boundary"), "left")
    is_boundary = F.col("fold") == "boundary"
    return kept.withColumns({
        "action": F.when(is_boundary & ~F.col("action").isin(DELETED, SOFT_DELETED), INSERTED).otherwise(F.col("action")),
        "diff": F.when(is_boundary, EMPTY_DIFF).otherwise(F.col("diff")),
        "snapshot": F.when(is_boundary, F.col("state")).otherwise(F.col("snapshot")),
        "error": F.when(~is_boundary, F.col("error")),
    }).select(*columns)


def compact_entity(df: DataFrame, entity_type: str, entity_id: str, tenant_id: str | None = None, retain_tail: int = 50) -> DataFrame:
    """The audit log after compaction of one entity: of the rows of one tenant, of those
    without a tenant (''), or (None) of all its rows as a single history."""
    asked = (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)
    if tenant_id is not None:
        asked &= tenant() == tenant_id
    asked = F.coalesce(asked, F.lit(False))
    one_history = df.where(asked).withColumns({"_tenant": F.col("tenant_id"), "tenant_id": F.lit("")})
    folded = compact(one_history, retain_tail).withColumn("tenant_id", F.col("_tenant")).drop("_tenant")
    return df.where(~asked).unionByName(folded)


def sweep(df: DataFrame, out_path: str, min_rows: int = 200, retain_tail: int = 50, limit: int | None = 100) -> int:
    """Compacts the candidates together, in one job, and writes the log to a new path,
    which the caller publishes. Returns the number of rows folded away; a sweep is
    bounded by its number of streams."""
    chosen = stored(candidates(df, min_rows, limit).select(*STREAM, "total"))
    compact(df, retain_tail, chosen).write.mode("errorifexists").parquet(out_path)
    return chosen.agg(F.coalesce(F.sum(F.greatest(F.col("total") - retain_tail - 1, F.lit(0))), F.lit(0))).first()[0]


def _step(state: dict, row: dict) -> Iterator[dict]:
    try:
        if row["snapshot"] is not None and row["action"] in (INSERTED, UPDATED):
            state["doc"] = jp.parse(row["snapshot"])
        elif row["diff"] and row["diff"] != EMPTY_DIFF:
            state["doc"] = jp.apply(state["doc"], row["diff"])
    except (ValueError, KeyError, TypeError) as e:
        raise HistoryError(f"row {row['id']} can't be replayed: {e}") from e
    if row["fold"] == "boundary":
        yield {"id": row["id"], "state": jp.dump(state["doc"])}


def summary(df: DataFrame, retain_tail: int) -> DataFrame:
    """Per stream: rows_before, rows_removed, rows_after, snapshot_written."""
    counts = ranked(df, retain_tail).groupBy(*STREAM).agg(F.count("*").alias("rows_before"), F.count_if(F.col("fold") == "remove").alias("rows_removed"), F.bool_or(F.col("fold") == "boundary").alias("snapshot_written"))
    return counts.withColumn("rows_after", F.col("rows_before") - F.col("rows_removed"))
