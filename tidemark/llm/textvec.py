"""Vectorised text kernels over Arrow batches: every text of a slice is handled
by the same numpy calls, with document boundaries kept as offsets.

All functions work on UTF-8 bytes (``uint8``) or code points (``uint32``) laid
end to end. Hashes are 64-bit and wrap around on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled by one round of numpy calls. One longer text makes a round of its own.
SLICE_BYTES = 512 << 10

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _values(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


BYTE_VALUES = _values(256, 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0xD6E8FEB86659FD93  # odd, and 3 modulo 8
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 2)
        one = np.ones(1, np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers["p"] = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
        _powers["q"] = np.concatenate([one, np.cumprod(np.full(size, inverse, np.uint64))])
    return _powers["p"], _powers["q"]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about SLICE_BYTES text bytes; yields the
    rows, their bytes laid end to end, and n + 1 offsets. Null texts are empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no batches


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word positions within a row."""
    if not len(is_word):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[full[1:] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Prefix:
    """Prefix sums of a polynomial hash; any substring's hash follows in O(1)."""

    def __init__(self, values: np.ndarray):
        self.p, self.q = _pow(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.p[: len(values)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        part = (self.sums[ends] - self.sums[starts]) * self.q[starts]
        return mix(part + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(BYTE_VALUES[data]).hash(starts, ends)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; len(hashes) - n + 1 of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(count)
    return Prefix(hashes).hash(at, at + n)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one string, its code points, and n + 1 offsets into both."""
    joined = "".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets
