"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries between pre-tokens come from code-point class arrays and a scan over
transition functions. Each character is a function on the automaton's states;
functions compose associatively and, closed under composition, are few, so a
composition is one table look-up. Blocks of characters are scanned side by side,
and then the blocks' totals are. No regular expression runs.

The resulting slices feed pair merging, whose results are cached by slice, and
the token ids are decoded again through the vocabulary's bytes.

Edge cases: a null text counts as empty and gives no tokens; the hash of no ids
and of no bytes is that of the empty string. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import named

#: Cached slices of one Python worker, about 50 MB at most; a full cache starts anew.
CACHE_ENTRIES = 150_000
#: Longer slices are merged with a heap.
LONG_PIECE = 64

L, N, O, SP, W, C2, C3 = range(7)  # letter, number, other, space, other white space, apostrophe with one or two letters to come
FRESH, IN_L, IN_N, IN_O, AFTER_SP, AFTER_W, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> int:
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return FRESH
    if symbol in (C2, C3):  # an apostrophe begins a contraction only where a token begins
        return IN_O if state in (IN_O, AFTER_SP) else (ONE_LEFT, TWO_LEFT)[symbol == C3]
    return (IN_L, IN_N, IN_O, AFTER_SP, AFTER_W)[symbol]


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function (the second half: as first of a text), the
    composition table, and each function's value at FRESH."""
    symbols = [tuple(_step(s, x) for s in range(8)) for x in range(7)]
    symbols += [(f[FRESH],) * 8 for f in symbols]
    known = {tuple(range(8)): 0}
    for f in symbols:
        known.setdefault(f, len(known))
    found = list(known)
    for f in found:  # grows while it is read
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                found.append(h)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.int32)
    return np.array([known[f] for f in symbols], np.int32), compose, np.array([f[FRESH] for f in found], np.int8)


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Number of the composition of all functions up to each position."""
    n, m = len(functions), compose.shape[0]
    table = compose.ravel()
    width = max(1, int(np.sqrt(n) // 4))
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.int32)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    for k in range(1, width):
        grid[k] = table[grid[k - 1] * m + grid[k]]
    if blocks > 1:
        before = np.zeros(blocks, np.int32)
        before[1:] = _scan(grid[-1][:-1].copy(), compose) if blocks > 64 else _walk(grid[-1][:-1], compose)
        grid = table[before[None, :] * m + grid]
    return grid.T.ravel()[:n]


def _walk(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(functions), np.int32), 0
    for i, f in enumerate(functions):
        at = out[i] = compose[at, f]
    return out


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, O, np.int8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = L if kind == "L" else N
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = W
    table[0x20] = SP
    return table


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end; the last value is the end."""
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    ends = np.zeros(n, np.int64)  # last position of the text
    lengths = np.diff(offsets)
    ends = np.repeat(offsets[1:] - 1, lengths)
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        a = points[np.minimum(at + 1, n - 1)]
        b = points[np.minimum(at + 2, n - 1)]
        two = np.isin(a, [ord(x) for x in "stmd"]) & (at + 1 <= ends[at])
        three = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (at + 2 <= ends[at])
        kind[at[three]] = C3
        kind[at[two]] = C2
    numbers, compose, value = _monoid()
    state = np.empty(n, np.int8)
    state[0] = FRESH
    state[1:] = value[_scan(numbers[kind + 7 * first], compose)][:-1]
    state[first] = FRESH
    blank = (kind == SP) | (kind == W)
    ends_run = np.zeros(n, bool)  # white space before a visible character of the same text
    ends_run[:-1] = ~blank[1:] & ~first[1:]
    after_blank = (state == AFTER_SP) | (state == AFTER_W)
    same = (state == IN_L) & (kind == L) | (state == IN_N) & (kind == N) | (state == IN_O) & (kind != L) & (kind != N)
    begins = np.where(blank, ~after_blank | ends_run, (state != AFTER_SP) & ~same)
    begins &= (state != ONE_LEFT) & (state != TWO_LEFT)
    begins |= (state == FRESH)
    return np.append(np.flatnonzero(begins), n)


class Codec:
    """Encodes by a rank file; one per Python worker."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.packed: dict[str, bytes] = {}
        self.written = _Written(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        top = sys.maxsize
        scores = [ranks.get(a + b, top) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == top:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], top)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], top)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same in n log n: the lowest rank first, the leftmost among equals."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has merged meanwhile
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, bytes, np.ndarray]]:
        """For each text: ids, ids as text, the bytes they decode to, and each
        pre-token's first code point (for decoding parts)."""
        joined, points, offsets = tv.code_points(texts)
        cuts = boundaries(points, offsets)
        at = cuts.tolist()
        slices = [joined[a:b] for a, b in zip(at, at[1:])]
        if len(self.written) > CACHE_ENTRIES:
            self.written.clear()
            self.packed.clear()
        written = list(map(self.written.__getitem__, slices))  # a missing slice is merged here
        packed = list(map(self.packed.__getitem__, slices))
        ids = np.frombuffer(b"".join(packed), np.int32)
        sizes = np.zeros(len(slices) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, packed), np.int64, len(slices)) >> 2, out=sizes[1:])
        flat, ends = self.decode_all(ids)
        first = np.searchsorted(cuts, offsets)
        for k in range(len(texts)):
            lo, hi = int(first[k]), int(first[k + 1])
            a, b = int(sizes[lo]), int(sizes[hi])
            yield ids[a:b], " ".join(written[lo:hi]), flat[ends[a] : ends[b]], cuts[lo:hi] - offsets[k]

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (and the end)."""
        sizes = self.sizes[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        take = np.repeat(self.begins[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[take].tobytes(), ends

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(np.asarray(ids, np.int64))[0]


class _Written(dict):
    """Ids as text by slice; a missing slice is merged, and both caches take it."""

    def __init__(self, own: Codec):
        self.own = own

    def __missing__(self, piece: str) -> str:
        ids = self.own.merge(piece.encode("utf-8"))
        self.own.packed[piece] = np.array(ids, np.int32).tobytes() if len(ids) > 8 else _PACK[len(ids)](*ids)
        self[piece] = out = " ".join(map(str, ids))
        return out


_PACK = [struct.Struct(f"={n}i").pack for n in range(9)]


_codecs: dict[str, Codec] = {}


def codec(rank_file: str) -> Codec:
    if rank_file not in _codecs:
        _codecs[rank_file] = Codec(rank_file)
    return _codecs[rank_file]


def _located(spark, rank_file: str) -> str:
    """Executors may lack the file, so Spark ships it (about 1 MB) to each once."""
    spark.sparkContext.addFile(rank_file)
    return rank_file.rsplit("/", 1)[-1]


def encode(documents: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of every whole text, without special tokens: the kept columns and
    token_ids, n_tokens, piece_starts (each pre-token's first code point),
    ids_sha256 and decoded_sha256 (of the ids decoded again)."""
    return _encoded(documents, rank_file, text, keep, True)


def encode_digest(documents: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same without the ids themselves."""
    return _encoded(documents, rank_file, text, keep, False)


def _encoded(documents: DataFrame, rank_file: str, text: str, keep: tuple[str, ...], full: bool) -> DataFrame:
    name = _located(documents.sparkSession, rank_file)
    rows = documents.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for batch in batches:
            for part, _, _ in tv.slices(batch):
                counts, ids_hash, text_hash, all_ids, starts = [], [], [], [], []
                for ids, written, decoded, at in own.encode_all(part.column("text").to_pylist()):
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(written.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded).hexdigest())
                    if full:
                        all_ids.append(ids)
                        starts.append(at.astype(np.int32))
                out = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                if full:
                    out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, names)

    kept = rows.schema.fields[:-1]
    names = [f.name for f in kept] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "piece_starts"] * full
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["token_ids array<int>, piece_starts array<int>"] * full)
    out = rows.mapInArrow(run, schema)
    return out.toDF(*keep, *out.columns[len(keep) :])


def decode(encoded: DataFrame, rank_file: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that an ids column stands for."""
    name = _located(encoded.sparkSession, rank_file)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema.fields)}, `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for batch in batches:
            found = [own.decode(x or []) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, to])

    return encoded.mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
