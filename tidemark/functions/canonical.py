"""Canonical text of rows, keyed hashes, and JSON checks, as column expressions."""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of a row's fields in its canonical text.
FIELDS = ("id", "entity_type", "entity_base_type", "entity_id", "action", "occurred_on_utc", "user_id", "user_display", "user_type", "tenant_id", "correlation_id", "diff", "snapshot", "error")
NULL_MARK = "-1:"


def field(value: Column) -> Column:
    """The value's length in UTF-8 bytes, a colon, the value; -1: for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK))


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since 1970 (UTC), as text; the column has no time zone."""
    micros = F.unix_micros(F.to_timestamp(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))
    return F.floor(micros / 1000).cast("string")


def canonical_value(value: Column, kind: str) -> Column:
    """Text of a custom column: booleans in lower case, instants round-trip, bytes in base64."""
    if kind == "boolean":
        return F.when(value, "true").when(~value, "false")
    if kind.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
    if kind == "binary":
        return F.base64(value)
    return value.cast("string")


def custom_texts(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    """The texts of a table's custom columns, for ``canonical`` and what calls it."""
    kinds = dict(df.dtypes)
    return {name: canonical_value(F.col(name), kinds[name]) for name in names}


def canonical(previous_hash: Column, custom: dict[str, Column] | None = None) -> Column:
    """The text that a row's hash covers: its fields, its custom columns by name, the hash before it."""
    parts = [field(epoch_millis(F.col(c)) if c == "occurred_on_utc" else F.col(c)) for c in FIELDS]
    custom = custom or {}
    parts.append(field(F.lit(str(len(custom)))))
    for name in sorted(custom):
        parts += [field(F.lit(name)), field(custom[name])]
    return F.concat(*parts, field(previous_hash))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash in lower hex, from two plain hashes."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def chain_key(text: str) -> bytes:
    """A base64 key of at least 16 bytes."""
    key = base64.b64decode(text, validate=True)
    if len(key) < 16:
        raise ValueError("a chain key has at least 16 bytes")
    return key


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value, with nothing behind it."""
    end = "tidemark-end"
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{end}"]')), "array<string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    strict = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{end}"]')))
    return F.coalesce(strict.isNotNull() & (F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == end), F.lit(False))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
