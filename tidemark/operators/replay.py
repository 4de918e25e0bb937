"""Time travel: the state of entities as of an instant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonpatch as jp
from ..functions.canonical import quoted
from ..plans.fold import fold_sorted
from ..schema import DELETED, EMPTY_DIFF, INSERTED, SOFT_DELETED, STREAM, UPDATED, tenant
from .filters import instant

_OPS = "array<struct<op:string,path:string,value:{}>>"


def _until(df: DataFrame, as_of) -> DataFrame:
    return df.where(F.col("occurred_on_utc") <= instant(as_of)).withColumn("tenant", tenant())


def _from_snapshot(rows: DataFrame) -> DataFrame:
    """Drops what the freshest usable snapshot makes needless, before any fold; adds
    first_action and last_action of the whole stream."""
    newest = Window.partitionBy(*STREAM).orderBy(F.desc("occurred_on_utc"), F.desc("id"))
    usable = F.col("snapshot").isNotNull() & F.col("action").isin(INSERTED, UPDATED)
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = newest.rowsBetween(Window.unboundedPreceding, -1)  # grows by a row at a time
    rows = rows.withColumns({
        "first_action": F.last("action").over(whole), "last_action": F.first("action").over(whole),
        "_later": F.coalesce(F.max(usable).over(later), F.lit(False)),
    })
    return rows.where(~F.col("_later")).drop("_later")


def reconstruct(df: DataFrame, as_of) -> DataFrame:
    """(entity_type, entity_id, tenant, state, error) for every stream with rows by
    then. state is JSON, null after a deletion. error tells of a history that begins
    with another action than an insert, or of a patch that doesn't fit."""
    rows = _from_snapshot(_until(df, as_of)).select(*STREAM, "occurred_on_utc", "id", "action", "diff", "snapshot", "first_action", "last_action")
    return fold_sorted(rows, list(STREAM), ["occurred_on_utc", "id"], dict, _step, _end, "entity_type string, entity_id string, tenant string, state string, error string")


def _step(state: dict, row: dict) -> Iterator[dict]:
    if not state:
        state.update(key={k: row[k] for k in STREAM}, doc={}, error=None, gone=row["last_action"] in (DELETED, SOFT_DELETED))
        if not state["gone"] and row["first_action"] != INSERTED:
            state["error"] = "the history begins with another action than an insert"
    if state["gone"] or state["error"]:
        return iter(())
    try:
        if row["snapshot"] is not None and row["action"] in (INSERTED, UPDATED):
            state["doc"] = jp.parse(row["snapshot"])
            if not isinstance(state["doc"], dict):
                raise jp.PatchError("the snapshot is no object")
        elif row["diff"] and row["diff"] != EMPTY_DIFF:
            state["doc"] = jp.apply(state["doc"], row["diff"])
    except (ValueError, KeyError, TypeError) as e:
        state["error"] = f"row {row['id']}: {e}"
    return iter(())


def _end(state: dict) -> Iterator[dict]:
    yield state["key"] | {"state": None if state["gone"] or state["error"] else jp.dump(state["doc"]), "error": state["error"]}


def reconstruct_many(df: DataFrame, ids: DataFrame, entity_type: str, as_of) -> DataFrame:
    """Every asked entity_id of a type, with its tenants' states or null. ids: a column entity_id."""
    wanted = ids.select("entity_id").distinct()
    rows = df.where(F.col("entity_type") == entity_type).join(wanted, "entity_id", "left_semi")
    return wanted.join(reconstruct(rows, as_of), "entity_id", "left").select("entity_id", "tenant", "state", "error")


def is_flat(df: DataFrame) -> DataFrame:
    """One row: whether reconstruct_flat can take all of these diffs."""
    ops = F.from_json("diff", "array<struct<op:string,path:string>>")
    flat = F.forall(F.coalesce(ops, F.array().cast("array<struct<op:string,path:string>>")), lambda o: o["op"].isin("add", "replace", "remove") & o["path"].rlike("^/[^/]*$"))
    return df.agg(F.coalesce(F.bool_and(flat & F.col("snapshot").isNull()), F.lit(True)).alias("flat"))


def _operations(diffs: pd.Series) -> pd.Series:
    return diffs.map(lambda d: [{"op": o["op"], "path": o["path"], "value": jp.dump(o.get("value"))} for o in jp.parse(d)])


def reconstruct_flat(df: DataFrame, as_of) -> DataFrame:
    """(entity_type, entity_id, tenant, path, value): the state as properties, for
    histories of additions, replacements and removals at the top level and without
    snapshots (see is_flat). The last operation of a path decides, so no fold runs:
    one aggregation, combined before the shuffle. Deleted entities have no rows."""
    rows = _until(df, as_of)
    # Spark's reader would rewrite fractions and exponents, so diffs with such numbers are read in Python; the rest natively
    rewritten = F.coalesce(F.col("diff").rlike("[0-9][.eE]"), F.lit(False))
    head = [*STREAM, "occurred_on_utc", "id"]
    texts, kinds = F.from_json("diff", _OPS.format("string")), F.from_json("diff", _OPS.format("variant"))
    ops = rows.where(~rewritten).select(*head, F.posexplode(F.arrays_zip(texts.alias("t"), kinds.alias("k"))).alias("place", "o"))
    value = F.when(F.schema_of_variant("o.k.value") == "STRING", quoted(F.col("o.t.value"))).otherwise(F.coalesce("o.t.value", F.lit("null")))
    ops = ops.select(*head, "place", F.struct("o.t.op", "o.t.path", value.alias("value")).alias("o"))
    exact = F.pandas_udf(_operations, _OPS.format("string"))
    ops = ops.unionByName(rows.where(rewritten).select(*head, F.posexplode(exact("diff")).alias("place", "o")))
    last = ops.groupBy(*STREAM, F.col("o.path").alias("path")).agg(F.max_by(F.struct("o.op", "o.value"), F.struct("occurred_on_utc", "id", "place")).alias("o"))
    alive = rows.groupBy(*STREAM).agg(F.max_by("action", F.struct("occurred_on_utc", "id")).alias("last")).where(~F.col("last").isin(DELETED, SOFT_DELETED)).drop("last")
    kept = last.where(F.col("o.op") != "remove").select(*STREAM, "path", F.col("o.value").alias("value"))
    return kept.join(alive, list(STREAM), "left_semi")
