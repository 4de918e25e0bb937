"""LM scoring: cross-entropy difference between a target and a background model.

Both are bigram models over one vocabulary: all words of all documents, an unknown
word for others, and a start mark. Both have the same order and smoothing:

    p(w | u) = weight c(u, w) / c(u) + (1 - weight) (c(w) + 1) / (N + V)

(the second term alone where c(u) is 0). The target model counts the target
documents, the background model all documents. A word's loss is -log p; a
document's score is the mean over its words of target loss less background loss,
so the lower, the more like the target.

Counts cover every whole document, all words and all bigrams, by hashes of 63 bits,
and stay in Spark. Tasks cut their rows into batches of about ``HELD_WORDS`` words.
A batch's request lists its distinct keys (bigrams, words, and words before a word)
in order, with their counts; it is cut into parts by ranges of keys, and the parts are
dealt. One part of all batches gives the sums of its keys, and answers each request by
them. A batch, its words kept as numbers in its own list of words, meets its answers
again and adds up its losses. So what travels is a batch's distinct keys, packed, not
its words. A key comes once from each batch at most, however frequent it is, and
there is a part for each ``PART_BYTES`` of text, so parts don't grow with the corpus.

Edge cases: null, empty and wordless texts have no words, losses and difference 0;
very long texts are counted whole, in a batch of their own; repeated rows count and are
scored each; without target documents the target model is the smoothed uniform one;
words that weren't counted have counts of 0; an empty table gives no rows; kept columns
may have any names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_folder, in_small_batches, named, scratch, small_enough, table

WEIGHT = 0.75
#: Stand for the start of a text and for words outside a closed vocabulary; words' hashes have the highest bit set.
START, UNKNOWN = 0, 1
#: Words of a batch, beyond which a task closes it.
HELD_WORDS = 3_500_000
#: Text bytes of the corpus for each part that keys are dealt in.
PART_BYTES = 8 << 20
#: Words of a piece of a batch's stored words. Larger values, half a megabyte or more, crowd the JVM's heap.
PIECE_WORDS = 1 << 17
#: Rows of the table of batches: a document, a piece of a batch's words, a part of its request.
DOCUMENT, WORDS, REQUEST = 0, 1, 2
_COLUMNS = "batch long, part int, n_words int, keys binary, n binary, n_target binary, kind int"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the lowest first, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys, packed as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _hashes(data: np.ndarray, offsets: np.ndarray, closed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and row; words outside a closed vocabulary are UNKNOWN."""
    data = tv.LOWER[data]
    starts, ends, rows = tv.spans(tv.ALNUM[data], offsets)
    words = tv.word_hashes(data, starts, ends) | np.uint64(1 << 63)
    return words if closed is None else np.where(np.isin(words, closed), words, np.uint64(UNKNOWN)), rows


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each value's place among them. Goes through
    them by their highest bits, since np.unique would hold several copies of all."""
    at, found, below = np.empty(len(values), np.int32), [values[:0]], 0
    highest = (values >> np.uint64(60)).astype(np.uint8)
    for k in range(16):
        here = np.flatnonzero(highest == k)
        some, places = np.unique(values[here], return_inverse=True)
        at[here] = places + below
        found.append(some)
        below += len(some)
    return np.concatenate(found), at


def _keys(words: np.ndarray, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a batch, ascending, and where among them are each word's
    bigram, the word itself and the word before it. words: its distinct words, the
    start mark first; numbers: each word's place there; lengths: words of each text.
    Keys of words are odd, others even."""
    before = np.empty_like(numbers)
    before[:1], before[1:] = 0, numbers[:-1]
    firsts = np.cumsum(lengths) - lengths
    before[firsts[lengths > 0]] = 0
    one, n, k = np.uint64(1), len(numbers), len(words)
    every = np.empty(n + 2 * k, np.uint64)
    with np.errstate(over="ignore"):
        spread = tv.mix(words + one)
        every[:n] = tv.mix(spread[before] * np.uint64(3) + words[numbers]) & ~one
    every[n : n + k], every[n + k :] = tv.mix(spread ^ np.uint64(0x5A5A5A5A)) | one, tv.mix(spread ^ np.uint64(0xA5A5A5A5)) & ~one
    keys, at = _ranked(every)
    return keys, at[:n], at[n : n + k][numbers], at[n + k :][before]


def _batches(rows: DataFrame, parts: int, closed: np.ndarray | None) -> tuple[DataFrame, str]:
    """Stores the table of batches of (k0, k1, ..., target, text): its documents with
    their kept columns, its words, and its request in at most ``parts`` parts. Returns it and its requests' folder."""
    kept = rows.select(*[c for c in rows.columns if c not in ("target", "text")])
    held = rows.sparkSession.sparkContext.broadcast(closed)
    names = [*kept.columns, *[c.split()[0] for c in _COLUMNS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, docs, words, lengths, targets, size = held.value, TaskContext.get().partitionId() << 32, [], [], [], [], 0
        types = {}

        def made(rows: int, /, **columns) -> pa.RecordBatch:
            filled = {"batch": pa.array(np.full(rows, number)), **columns}
            kinds = {"part": pa.int32(), "n_words": pa.int32(), "keys": pa.binary(), "n": pa.binary(), "n_target": pa.binary(), "kind": pa.int32()} | types
            return pa.RecordBatch.from_arrays([filled[c] if c in filled else pa.nulls(rows, kinds[c]) for c in names], names)

        def closing() -> Iterator[pa.RecordBatch]:
            place = 0
            for d, n in zip(docs, lengths):
                own_columns = dict(zip(d.schema.names, d.columns))
                yield made(len(n), **own_columns, part=pa.array(np.arange(place, place + len(n), dtype=np.int32)), n_words=pa.array(n.astype(np.int32)), kind=pa.array(np.full(len(n), DOCUMENT, np.int32)))
                place += len(n)
            n, wanted = np.concatenate(lengths), np.concatenate(targets)
            every = np.concatenate(words)
            words.clear()
            found, at = _ranked(every)
            del every
            order = np.argsort(-np.bincount(at, minlength=len(found)), kind="stable")  # frequent words get small numbers, which compress
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            found, at = np.concatenate([[np.uint64(START)], found[order]]), rank[at]
            pieces = 1 + len(at) // PIECE_WORDS
            for p, (x, y) in enumerate(zip(np.array_split(found, pieces), np.array_split(at, pieces))):
                yield made(1, part=pa.array([p], pa.int32()), keys=pa.array([_pack(x)]), n=pa.array([_pack(y)]), kind=pa.array([WORDS], pa.int32()))
            keys, pair, alone, prior = _keys(found, at, n)
            wanted = np.repeat(wanted, n)
            sums = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
            for x in (pair, alone, prior):
                sums[0] += np.bincount(x, minlength=len(keys))
                sums[1] += np.bincount(x[wanted], minlength=len(keys))
            del found, at, rank, order, pair, alone, prior, x, y
            part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            some, starts = np.unique(part, return_index=True)
            for p, i, j in zip(some, starts, np.append(starts[1:], len(keys))):
                yield made(1, part=pa.array([p], pa.int32()), keys=pa.array([_steps(keys[i:j])]), n=pa.array([_pack(sums[0][i:j])]), n_target=pa.array([_pack(sums[1][i:j])]), kind=pa.array([REQUEST], pa.int32()))

        for batch in batches:
            for piece, data, offsets in tv.slices(batch):
                hashes, owner = _hashes(data, offsets, own)
                columns = piece.drop_columns(["target", "text"])
                types.update({f.name: f.type for f in columns.schema})
                docs.append(columns)
                words.append(hashes)
                lengths.append(np.bincount(owner, minlength=piece.num_rows))
                targets.append(piece.column("target").to_numpy(zero_copy_only=False).astype(bool))
                size += len(hashes)
                if size >= HELD_WORDS:
                    yield from closing()
                    docs, words, lengths, targets, size, number = [], [], [], [], 0, number + 1
        if docs:
            yield from closing()

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields], _COLUMNS])
    made, at = rows.mapInArrow(run, schema), scratch(rows.sparkSession)
    made.write.partitionBy("kind").parquet(at)
    return rows.sparkSession.read.schema(made.schema).parquet(at), f"{at}/kind={REQUEST}"


class Counts(NamedTuple):
    """The counted documents and their columns, their table of batches and its requests' folder,
    the number of parts, and the hashes and entries of a closed vocabulary."""

    documents: DataFrame
    columns: tuple
    batches: DataFrame
    requests: str
    parts: int
    closed: np.ndarray | None
    entries: int | None


def _top_words(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of the n most frequent words, ascending."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tv.slices(batch):
                words, times = np.unique(_hashes(data, offsets, None)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], ["word", "n"])

    top = texts.select("text").mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return np.sort(top.toArrow().column("word").to_numpy().view(np.uint64))


def _rows(documents: DataFrame, text: str, keep: tuple[str, ...]) -> list:
    return [*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(*named([text]), F.lit("")).alias("text")]


def fit(documents: DataFrame, target_ids: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), vocabulary: int | None = None) -> Counts:
    """Counts all documents, and the target documents among them. target_ids: one
    column of ids. vocabulary: entries of a closed vocabulary, the most frequent words;
    all words if None. Scoring the same documents with the same keep counts them once."""
    ids = target_ids.toDF("id").where("id is not null").distinct().withColumn("target", F.lit(True))
    ids = F.broadcast(ids) if small_enough(ids) else ids
    texts = documents.select(*_rows(documents, text, keep), *[c.alias("id") for c in named([doc_id])]).join(ids, "id", "left").drop("id")
    texts = texts.select(*[c for c in texts.columns if c[0] == "k"], F.coalesce("target", F.lit(False)).alias("target"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    closed = None if vocabulary is None else _top_words(texts, vocabulary - 2)
    parts = 1 + size // PART_BYTES
    return Counts(documents, (text, tuple(keep)), *_batches(texts, parts, closed), parts, closed, None if closed is None else len(closed) + 2)


def _answers(requests: DataFrame) -> DataFrame:
    """Stores, for each request (asks), the sums of its keys' counts in all batches and in
    target documents; and for each part, in a row without a batch, how many words it has counted."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x.as_py())) for x in group.column("keys")]
        lengths = [len(x) for x in keys]
        ends = np.cumsum(lengths)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = [np.bincount(at, np.concatenate([_unpack(x.as_py()) if x.is_valid else np.zeros(k, np.uint64) for x, k in zip(group.column(c), lengths)]), minlength=len(found)).astype(np.int64) for c in ("n", "n_target")]
        words = (found & np.uint64(1)).astype(bool)
        totals = [int((sums[0][words] > 0).sum()), *[int(x[words].sum()) for x in sums]]
        asking = np.flatnonzero(group.column("asks").to_numpy())
        packed = [[_pack(x[at[(ends[i - 1] if i else 0) : ends[i]]]) for i in asking] + [None] for x in sums]
        n, part = len(asking) + 1, group.column("part")[0].as_py()
        batch = pa.array([*group.column("batch").to_numpy()[asking], None], pa.int64())
        only = [pa.array([0] * (n - 1) + [x], pa.int64()) for x in totals]
        return pa.Table.from_arrays([batch, pa.array([part] * n, pa.int32()), *[pa.array(x, pa.binary()) for x in packed], *only], ["batch", "part", "n", "n_target", "words", "total", "total_target"])

    schema = "batch long, part int, n binary, n_target binary, words long, total long, total_target long"
    made, at = requests.groupBy("part").applyInArrow(run, schema), scratch(requests.sparkSession)
    made.write.parquet(at)
    return requests.sparkSession.read.schema(made.schema).parquet(at)


def score(documents: DataFrame, counts: Counts, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), weight: float = WEIGHT, release: bool = False) -> DataFrame:
    """The kept columns of every row and n_words, target_loss, background_loss (means) and difference.
    release: requests are deleted once they are answered, before the answers travel; counts can't be used again."""
    kinds = F.col("kind")
    asked = ["batch", "part", "keys", "n", "n_target"]
    requests = counts.batches.where(kinds == REQUEST).select(*asked)
    own = counts.requests
    if (text, tuple(keep)) == counts.columns and documents.sameSemantics(counts.documents):
        batches, requests = counts.batches, requests.withColumn("asks", F.lit(True))
    else:
        rows = documents.select(*_rows(documents, text, keep)).withColumn("target", F.lit(False))
        batches, own = _batches(rows, counts.parts, counts.closed)
        nothing = F.lit(None).cast("binary")  # such documents ask, and don't count
        requests = requests.withColumn("asks", F.lit(False)).unionByName(batches.where(kinds == REQUEST).select(*asked).withColumns({"n": nothing, "n_target": nothing, "asks": F.lit(True)}))
    answers = _answers(requests)
    for at in {own, counts.requests} if release else ():
        drop_folder(documents.sparkSession, at)
    found = answers.where("batch is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "total", "total_target")]).first()
    entries, totals = counts.entries or found["words"] + 2, (found["total_target"], found["total"])
    kept = [f"k{i}" for i in range(len(keep))]

    def losses(answered: pa.Table, batch: pa.Table) -> pa.Table:
        documents = batch.filter(pc.equal(batch.column("kind"), DOCUMENT)).sort_by("part")
        listed = batch.filter(pc.equal(batch.column("kind"), WORDS)).sort_by("part")
        n = documents.column("n_words").to_numpy().astype(np.int64)
        words, numbers = (np.concatenate([_unpack(x.as_py()).astype(kind) for x in listed.column(c)]) for c, kind in (("keys", np.uint64), ("n", np.int32)))
        keys, pair, alone, prior = _keys(words, numbers, n)
        del words, numbers
        answered, owner = answered.sort_by("part"), np.repeat(np.arange(len(n)), n)
        means = []
        for column, total in zip(("n_target", "n"), totals):
            sums, lost = np.concatenate([_unpack(x.as_py()) for x in answered.column(column)]).astype(np.float64), np.empty(len(pair))
            for i in range(0, len(pair), PIECE_WORDS):
                some = slice(i, i + PIECE_WORDS)
                unigram, before = (sums[alone[some]] + 1) / (total + entries), sums[prior[some]]
                lost[some] = -np.log(np.where(before > 0, weight * sums[pair[some]] / np.maximum(before, 1) + (1 - weight) * unigram, unigram))
            means.append(np.bincount(owner, lost, minlength=len(n)) / np.maximum(n, 1))
            del sums, lost
        return pa.Table.from_arrays([*[documents.column(c) for c in kept], pa.array(n), *map(pa.array, means), pa.array(means[0] - means[1])], [*kept, *added])

    added = ["n_words", "target_loss", "background_loss", "difference"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in batches.select(*kept).schema.fields] + ["n_words long", *[f"{c} double" for c in added[1:]]])
    there = batches.where(kinds != REQUEST).select(*kept, "batch", "part", "n_words", "keys", "n", "kind")
    made = answers.where("batch is not null").select("batch", "part", "n", "n_target").groupBy("batch").cogroup(there.groupBy("batch")).applyInArrow(losses, schema)
    return made.toDF(*keep, *added)


@in_small_batches
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels mark as of good quality."""
    documents = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(documents, fit(documents, good), release=True)


def brute_force(rows: list[tuple], target_ids: set, vocabulary: int | None = None, weight: float = WEIGHT) -> list[tuple]:
    """(doc_id, n_words, difference) by dictionaries, for small tests without ties at the vocabulary's end."""
    import re
    from math import log

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = [(d, word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in rows]
    known = {w for w, _ in Counter(w for _, ws in split for w in ws).most_common(vocabulary and vocabulary - 2)}
    size, found = len(known) + 2, []
    for chosen in (lambda d: d in target_ids, lambda d: True):
        pairs, single, before = Counter(), Counter(), defaultdict(int)
        for d, ws in split:
            for u, w in zip(["<s>", *ws], ws) if chosen(d) else ():
                u, w = (x if x in known or x == "<s>" else "?" for x in (u, w))
                pairs[u, w] += 1
                single[w] += 1
                before[u] += 1
        found.append((pairs, single, before, sum(single.values())))
    out = []
    for d, ws in split:
        total = [0.0, 0.0]
        for u, w in zip(["<s>", *ws], ws):
            u, w = (x if x in known or x == "<s>" else "?" for x in (u, w))
            for k, (pairs, single, before, n) in enumerate(found):
                p = (single[w] + 1) / (n + size)
                total[k] -= log(weight * pairs[u, w] / before[u] + (1 - weight) * p if before[u] else p)
        out.append((d, len(ws), (total[0] - total[1]) / max(1, len(ws))))
    return out


