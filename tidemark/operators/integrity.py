"""The keyed hash chain of each stream: stamping, order, verification and pruning."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import canonical as cn
from ..plans import segments
from ..schema import STREAM, HistoryError, tenant
from ..sources.shared import stored

# fixed values: why a chain is broken
REASONS = ("MissingHashAfterChainStart", "BrokenLink", "UnknownKey", "ContentMismatch", "Truncated")
ANCHOR = "entity_type string, entity_id string, tenant string, latest_entry_hash string, row_count long, key_id int, pruned_row_count long, pruned_through_hash string"


def entry_hash(keys: dict[int, bytes], previous: Column | None = None, custom: dict[str, Column] | None = None) -> Column:
    """A row's hash under the key that its hash_key_id names (none: 0); null for an unknown key."""
    message = cn.canonical(F.col("previous_hash") if previous is None else previous, custom)
    out = F.lit(None).cast("string")
    for number, key in keys.items():
        out = F.when(F.coalesce("hash_key_id", F.lit(0)) == number, cn.hmac_sha256(key, message)).otherwise(out)
    return out


def stamp(batch: DataFrame, anchors: DataFrame, key_id: int, key: bytes, custom: dict[str, Column] | None = None) -> DataFrame:
    """The batch with previous_hash, entry_hash, hash_key_id and chain_sequence, in
    order of (time, id) of each stream, continuing from its anchor. Each hash needs the
    one before it, so a walk in order makes them; it holds one hash, and the batch's
    columns pass it as they are. The covered text is made beforehand, natively."""
    heads = anchors.select(*STREAM, F.col("latest_entry_hash").alias("_head"), F.col("row_count").alias("_base"))
    placeholder = "\x00"
    text = cn.canonical(F.lit(placeholder), custom)
    rows = batch.withColumns({"tenant": tenant(), "_text": F.substring(text, F.lit(1), F.length(text) - len("1:" + placeholder))})
    rows = rows.join(heads, list(STREAM), "left").select(*STREAM, "_text", "_head", "_base", F.struct(*batch.columns).alias("_row"))
    dealt = rows.repartition(*STREAM).sortWithinPartitions(*STREAM, "_row.occurred_on_utc", "_row.id")
    schema = StructType([f if f.name not in _STAMPED else StructField(f.name, _STAMPED[f.name]) for f in batch.schema.fields])
    return dealt.mapInArrow(_stamper(key_id, key, batch.columns), schema)


_STAMPED = {"previous_hash": StringType(), "entry_hash": StringType(), "hash_key_id": IntegerType(), "chain_sequence": LongType()}


def _stamper(key_id: int, key: bytes, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, n = None, None, 0
        for batch in batches:
            *stream, texts, heads, bases = (batch.column(k).to_pylist() for k in range(6))
            before, made, places = [], [], []
            for own, text, start, base in zip(zip(*stream), texts, heads, bases):
                if own != now:
                    now, head, n = own, start, base or 0
                before.append(head)
                covered = text + (cn.NULL_MARK if head is None else f"{len(head)}:{head}")
                head, n = hmac.new(key, covered.encode(), hashlib.sha256).hexdigest(), n + 1
                made.append(head)
                places.append(n)
            new = {"previous_hash": pa.array(before, pa.string()), "entry_hash": pa.array(made, pa.string()), "hash_key_id": pa.array([key_id] * len(made), pa.int32()), "chain_sequence": pa.array(places, pa.int64())}
            rows = dict(zip(columns, batch.column(6).flatten()))
            yield pa.RecordBatch.from_arrays([new[c] if c in new else rows[c] for c in columns], columns)

    return run


def advanced_anchors(anchors: DataFrame, stamped: DataFrame) -> DataFrame:
    """Anchors after a stamped batch."""
    new = stamped.groupBy("entity_type", "entity_id", tenant().alias("tenant")).agg(F.max_by("entry_hash", "chain_sequence").alias("head"), F.count("*").alias("added"), F.max_by("hash_key_id", "chain_sequence").alias("key"))
    joined = anchors.join(new, list(STREAM), "full_outer")
    return joined.select(
        *STREAM, F.coalesce("head", "latest_entry_hash").alias("latest_entry_hash"), (F.coalesce("row_count", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long").alias("row_count"),
        F.coalesce("key", "key_id").alias("key_id"), F.coalesce("pruned_row_count", F.lit(0)).cast("long").alias("pruned_row_count"), "pruned_through_hash",
    )


def no_anchors(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ANCHOR)


def walk_order(df: DataFrame) -> DataFrame:
    """Adds tenant and walk, each row's place in its stream's chain: rows with a
    sequence by it (then time and id), and those without among them where their time
    falls. A stream may lie in many tasks."""
    rows, order = _in_order(df.withColumn("tenant", tenant()))
    return segments.running(rows, list(STREAM), order, sums={"walk": F.lit(1)}).withColumn("walk", F.col("walk").cast("int")).select(*df.columns, *(["tenant"] if "tenant" not in df.columns else []), "walk")


def _in_order(rows: DataFrame) -> tuple[DataFrame, list]:
    """Rows (with tenant) and the columns that order them within their streams: where every
    row has its sequence, that decides; else a row without one needs to know what time the
    sequenced rows before and behind it have reached."""
    last = ["chain_sequence", "occurred_on_utc", "id"]
    loose = F.col("chain_sequence").isNull()
    if not rows.where(loose).limit(1).count():
        return rows, last
    timed = segments.running(rows, list(STREAM), [F.col("chain_sequence").asc_nulls_last(), "occurred_on_utc", "id"], maxes={"_reached": F.when(~loose, F.col("occurred_on_utc"))})
    rows = timed.withColumns({"_at": F.when(loose, F.col("occurred_on_utc")).otherwise(F.col("_reached")), "_loose": loose}).drop("_reached")
    return rows, ["_at", "_loose", *last]


def checked(df: DataFrame, anchors: DataFrame, keys: dict[int, bytes], custom: dict[str, Column] | None = None) -> DataFrame:
    """(entity_type, entity_id, tenant, id, entry_hash, walk, break_reason) of every row from
    its stream's first hashed one on; break_reason is null if none. A row's own hash is
    checked where the row lies; only hashes and times travel to where a chain is walked,
    and a chain may be walked by many tasks."""
    known = F.coalesce("hash_key_id", F.lit(0)).isin(*keys) if keys else F.lit(False)
    own = F.when(~known, REASONS[2]).when(~F.col("entry_hash").eqNullSafe(entry_hash(keys, custom=custom)), REASONS[3])
    # stored, since sampling the ranges would hash every row a second time
    narrow = stored(df.select("entity_type", "entity_id", tenant().alias("tenant"), "id", "occurred_on_utc", "chain_sequence", "entry_hash", "previous_hash", own.alias("_own")))
    rows, order = _in_order(narrow)
    there = F.col("entry_hash").isNotNull()
    rows = segments.running(rows, list(STREAM), order, sums={"walk": F.lit(1)}, maxes={"_started": there}, lags={"_before": F.col("entry_hash")})
    pruned = anchors.where("pruned_through_hash is not null").select(*STREAM, "pruned_through_hash")
    rows = rows.where("_started").join(pruned, list(STREAM), "left")
    expected = F.coalesce("_before", "pruned_through_hash")
    reason = F.when(~there, REASONS[0]).when(~F.col("previous_hash").eqNullSafe(expected), REASONS[1]).otherwise(F.col("_own"))
    return rows.select(*STREAM, "id", "entry_hash", "walk", reason.alias("break_reason"))


def verify_streams(df: DataFrame, anchors: DataFrame, keys: dict[int, bytes], custom: dict[str, Column] | None = None) -> DataFrame:
    """Per stream with rows or an anchor: verified rows, and the first break's reason and row."""
    rows = checked(df, anchors, keys, custom)
    bad = F.col("break_reason").isNotNull()
    found = rows.groupBy(*STREAM).agg(
        F.min(F.when(bad, F.col("walk"))).alias("first_bad"), F.min_by(F.when(bad, F.col("break_reason")), F.when(bad, F.col("walk"))).alias("reason"),
        F.min_by("id", F.when(bad, F.col("walk"))).alias("break_id"), F.min("walk").alias("start"), F.max("walk").alias("stop"), F.max_by("entry_hash", "walk").alias("head"), F.max_by("id", "walk").alias("last_id"),
    )
    all_ = df.select("entity_type", "entity_id", tenant().alias("tenant")).distinct()
    joined = all_.join(found, list(STREAM), "left").join(anchors, list(STREAM), "full_outer")
    verified = F.when(F.col("first_bad").isNotNull(), F.col("first_bad") - F.col("start")).otherwise(F.coalesce(F.col("stop") - F.col("start") + 1, F.lit(0)))
    left = F.col("row_count") - F.coalesce("pruned_row_count", F.lit(0))
    short = F.col("row_count").isNotNull() & F.when(F.col("head").isNull(), left > 0).otherwise((verified != left) | ~F.col("head").eqNullSafe(F.col("latest_entry_hash")))
    reason = F.coalesce(F.col("reason"), F.when(short, REASONS[4]))
    return joined.select(*STREAM, verified.cast("long").alias("verified"), reason.alias("reason"), F.when(F.col("reason").isNotNull(), F.col("break_id")).when(short, F.col("last_id")).alias("break_id"))


def verify_chain(df: DataFrame, anchors: DataFrame, keys: dict[int, bytes], *, entity_type: str | None = None, entity_id: str | None = None, tenant_id: str | None = None, custom: dict[str, Column] | None = None) -> DataFrame:
    """One row: is_valid, verified, and the first broken stream in the streams' order.
    verified counts the rows of the streams before it, and its own up to the break."""
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id)):
        if value is not None:
            df, anchors = df.where(F.col(name) == value), anchors.where(F.col(name) == value)
    if tenant_id is not None:
        df, anchors = df.where(tenant() == tenant_id), anchors.where(F.col("tenant") == tenant_id)
    found = stored(verify_streams(df, anchors, keys, custom))
    key = F.struct(*STREAM)
    first = found.where("reason is not null").agg(F.min_by(F.struct(key.alias("stream"), "reason", "break_id"), key).alias("broken"))
    # the streams up to the first broken one, counted without ordering them all
    summed = found.join(F.broadcast(first), F.col("broken").isNull() | (key <= F.col("broken.stream"))).agg(F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    return summed.join(F.broadcast(first)).select(F.col("broken").isNull().alias("is_valid"), "verified", *[F.col(f"broken.stream.{c}").alias(c) for c in STREAM], F.coalesce(F.col("broken.reason"), F.lit("None")).alias("reason"), F.col("broken.break_id").alias("break_id"))


def prunable(victims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of the victims, those whose removal keeps each chain whole: the rows that follow
    on the stream's pruned head without a gap, and rows of streams without an anchor or a hash."""
    marks = anchors.select(*STREAM, F.lit(True).alias("_anchored"), "pruned_through_hash")
    rows = victims.withColumn("tenant", tenant()).join(marks, list(STREAM), "left")
    rows = rows.withColumn("_hashed", F.col("entry_hash").isNotNull() & F.coalesce("_anchored", F.lit(False)))
    rows, order = _in_order(stored(rows))
    rows = segments.running(rows, [*STREAM, "_hashed"], order, lags={"_before": F.col("entry_hash"), "_behind": F.lit(True)})
    before = F.when(F.col("_behind").isNull(), F.col("pruned_through_hash")).otherwise(F.col("_before"))
    loose = ~F.col("previous_hash").eqNullSafe(before)
    # a stream's rows up to its first that doesn't follow on the one before it
    rows = stored(rows.withColumn("_cut", loose))
    cuts = rows.where("_hashed and _cut").groupBy(*STREAM).agg(F.min(F.struct(*order)).alias("_from"))
    found = rows.join(cuts, list(STREAM), "left").where(~F.col("_hashed") | F.col("_from").isNull() | (F.struct(*order) < F.col("_from")))
    return found.select(*victims.columns)


def pruned_anchors(anchors: DataFrame, removed: DataFrame) -> DataFrame:
    """Anchors after the removal of prunable rows: of each chain the last one tells."""
    rows, order = _in_order(removed.withColumn("tenant", tenant()).where("entry_hash is not null"))
    gone = rows.groupBy(*STREAM).agg(F.count("*").alias("n"), F.max_by("entry_hash", F.struct(*order)).alias("through"))
    joined = anchors.join(gone, list(STREAM), "left")
    return joined.withColumns({"pruned_row_count": F.col("pruned_row_count") + F.coalesce("n", F.lit(0)), "pruned_through_hash": F.coalesce("through", "pruned_through_hash")}).drop("n", "through")


def valid_anchors(anchors: DataFrame) -> DataFrame:
    """The anchors, if all of them can be true: counts that aren't negative, and both or none
    of the pruning marks. Raises otherwise, since a stream without its anchor could be cut short unseen."""
    both = (F.col("pruned_row_count") > 0) == F.col("pruned_through_hash").isNotNull()
    good = (F.col("row_count") > 0) & (F.col("pruned_row_count") >= 0) & (F.col("pruned_row_count") <= F.col("row_count")) & both
    if bad := anchors.where(~F.coalesce(good, F.lit(False))).limit(1).collect():
        raise HistoryError(f"an anchor that can't be true: {bad[0].asDict()}")
    return anchors
