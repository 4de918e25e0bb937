"""Bulk import of history from elsewhere."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonpatch as jp
from ..schema import COLUMNS, EMPTY_DIFF


_FRACTION = re.compile("[0-9][.eE]")


def _patch(before: str | None, after: str | None) -> tuple[str, str | None]:
    try:
        one, two = jp.parse(before or "{}"), jp.parse(after or "{}")
        if not isinstance(one, dict) or not isinstance(two, dict):
            raise ValueError("an image is no object")
        return jp.dump(jp.diff(one, two), exact=bool(_FRACTION.search(after or ""))), None
    except RecursionError:
        return EMPTY_DIFF, "PatchError: too many levels"
    except ValueError as e:
        return EMPTY_DIFF, f"{type(e).__name__}: {e}"


def _patches(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_patch(b, a) for b, a in zip(before, after)], columns=["diff", "error"])


def nested_diff(before: Column, after: Column) -> Column:
    """struct<diff, error> of two JSON objects; a bad image gives an empty diff and an error."""
    return F.pandas_udf(_patches, "diff string, error string")(before, after)


def imported(records: DataFrame, existing: DataFrame, batch: str) -> DataFrame:
    """Audit rows of records (entity_type, entity_id, action, occurred_on_utc, user_id,
    tenant_id, source_id, before_json, after_json). A record with a source_id that the
    batch has already is skipped; without one it is always taken. Records that can't be
    diffed become rows with an error."""
    if not batch or not batch.strip():
        raise ValueError("an import has a batch name")
    tag = f"import:{batch}"
    correlation = F.when(F.col("source_id").isNull(), tag).otherwise(F.concat(F.lit(f"{tag}#"), F.col("source_id")))
    rows = records.withColumn("correlation_id", correlation)
    known = existing.where(F.col("correlation_id").startswith(tag)).select(F.col("correlation_id").alias("_known")).distinct()
    rows = rows.join(known, (F.col("correlation_id") == F.col("_known")) & F.col("source_id").isNotNull(), "left_anti")
    rows = rows.withColumn("_d", nested_diff(F.col("before_json"), F.col("after_json")))
    made = {
        "id": F.expr("uuid()") if "id" not in records.columns else F.col("id"), "diff": F.col("_d.diff"), "error": F.col("_d.error"),
    }
    types = {"action": "int", "occurred_on_utc": "timestamp_ntz", "hash_key_id": "int", "chain_sequence": "long"}
    return rows.select(*[(made[c] if c in made else F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def result(records: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: written, skipped, dead_lettered."""
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("written"), F.count_if(F.col("error").isNotNull()).alias("dead_lettered"), F.count("*").alias("n"))
    return records.agg(F.count("*").alias("all")).join(F.broadcast(counts)).select("written", (F.col("all") - F.col("n")).alias("skipped"), "dead_lettered")
