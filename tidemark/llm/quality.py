"""Quality classifier: supervised subword embeddings.

A document's features are hashed words, pairs of neighbouring words and character
n-grams of words (with marks at word edges). Each hash bucket has a learned
vector; a document is the mean of its features' vectors, and a softmax over two
outputs gives its score. Two pairs have buckets of their own: a word equal to its
predecessor, and a run of five words that the document had before.

Training is plain numpy stochastic gradient descent over at most ``sample_rows``
labelled rows (a documented bound; features of those rows come from Spark tasks,
the loop runs on the driver). Scoring is linear in the mean, so each bucket's
vector times the output layer is one number, and that table of ``buckets`` floats
(1 MB) is what tasks get.

Edge cases: null and empty texts, and texts of white space alone, have no
features and score by the output bias alone; repeated rows each give a row; with
no labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out, labelled_sample, named, stored, table

BUCKETS = 1 << 18
SAMPLE_ROWS = 4000
NGRAMS = (2, 3, 4)
SAME, SEEN = 0, 1
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(16)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text that each belongs to."""
    _, points, offsets = tv.code_points(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    visible = (points != 32) & ((points < 9) | (points > 13))
    starts, ends, rows = tv.spans(visible, offsets)
    prefix = tv.Prefix(tv.mix(points.astype(np.uint64) + _SALT[0]))
    words = prefix.hash(starts, ends)
    found, owner = [words], [rows]
    if len(words) > 1:
        beside = rows[1:] == rows[:-1]
        same = beside & (words[1:] == words[:-1])
        pairs = tv.mix(words[1:] * _SALT[1] + words[:-1])
        pairs[same] = SAME
        found.append(pairs[beside])
        owner.append(rows[1:][beside])
    if len(words) >= 5:
        runs = tv.ngram_hashes(words, 5)
        whole = rows[: len(runs)] == rows[4:]
        key = tv.mix(runs[whole] + rows[: len(runs)][whole].astype(np.uint64) * _SALT[2])
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order[1:]] == key[order[:-1]]]
        found.append(np.full(len(again), SEEN, np.uint64))
        owner.append(rows[: len(runs)][whole][again])
    word_of = np.cumsum(np.bincount(starts, minlength=len(points))) - 1
    for n in NGRAMS:
        at = np.flatnonzero(visible[: len(points) - n + 1]) if len(points) >= n else np.zeros(0, np.int64)
        w = word_of[at]
        inside = at + n <= ends[w]
        at, w = at[inside], w[inside]
        edge = (at == starts[w]).astype(np.int64) + 2 * (at + n == ends[w])
        found.append(prefix.hash(at, at + n) + np.array(_SALT[4:8], np.uint64)[edge])
        owner.append(rows[w])
    buckets = (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    """Score of a text: the logistic function of bias plus the mean of its buckets' values."""

    values: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, owner = features(texts)
        total = np.bincount(owner, self.values[buckets], minlength=len(texts))
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-(self.bias + total / count)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], *, dim: int = 16, epochs: int = 8, rate: float = 0.6, seed: int = 1) -> Model:
    """rows: label, buckets and their counts of each document."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    ones = sum(r[0] for r in rows)
    weight = [len(rows) / 2 / max(1, len(rows) - ones), len(rows) / 2 / max(1, ones)]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, buckets, counts = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(dim, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= min(weight[label], 3.0)
            back = p @ output
            output -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            if len(buckets):
                vectors[buckets] -= (lr * share)[:, None] * back[None, :]
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in tv.slices(batch):
            buckets, owner = features(part.column("text").to_pylist())
            key, count = np.unique(owner * BUCKETS + buckets, return_counts=True)
            cut = np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS)
            which, count = (key % BUCKETS).astype(np.int32), count.astype(np.int32)
            both = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:])] for x in (which, count)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), *(pa.array(x, pa.binary()) for x in both)], ["doc_id", "label", "buckets", "counts"])


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """Learns from rows that aren't held out; at most sample_rows of them, one of each id."""
    sample = labelled_sample(documents, labels, label, sample_rows)
    made = stored(sample.mapInArrow(_counted, "doc_id string, label int, buckets binary, counts binary"))
    found, buckets, counts = [], bytearray(), bytearray()  # two long runs, which leave no holes in the driver's memory
    for r in made.toLocalIterator():
        found.append((r["doc_id"], r["label"], len(buckets) // 4, (len(buckets) + len(r["buckets"])) // 4))
        buckets += r["buckets"]
        counts += r["counts"]
    which, times = np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.int32)
    rows = [(d, label, which[a:b], times[a:b]) for d, label, a, b in found]
    rows.sort(key=lambda r: (r[0], r[2].tobytes()))
    return train([r[1:] for r in rows], **options)


def score(documents: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "score") -> DataFrame:
    """The kept columns of every row and the score of its whole text."""
    rows = documents.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))] + ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(held.value.scores(part.column("text").to_pylist()), pa.float64())], names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["value double"])
    return rows.mapInArrow(run, schema).toDF(*keep, to)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
