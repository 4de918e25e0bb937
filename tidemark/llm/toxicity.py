"""Toxicity: a counterfactual-regularised classifier of sentences and documents.

A sentence's features are the words that occur in it and their first few bytes,
hashed; its evidence is the sum of their learned weights, none of them negative.
A document's logit is linear in the evidence of its worst sentence and in the
evidence of all sentences for its length. Features are those that are
significantly likelier in toxic than in clean labelled documents.

Identity terms are swapped in labelled sentences (and put in place of a word in
some that have none), and the squared change of the sentence's evidence, by all
features of both terms (word and beginnings) and for its number of features, is part
of the loss, over all mentions of the sample; an identity term's features count
whether significant or not. So the mention
of a group neither raises nor lowers a score: only what is said about it does.

Training runs numpy gradient descent over at most ``sample_rows`` labelled rows (a
documented bound; their sentences' features come from Spark tasks). The weights
(1 MB) are what scoring tasks get; whole texts are scored.

Edge cases: null, empty and wordless texts have no evidence and score by the bias
alone; repeated rows each give a row; with no labelled row every score is 0.5.
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
#: Bytes of a word's beginnings that are features beside the word.
BEGINNINGS = (4, 6, 7)
#: Words of a document that weigh as much as the document itself in its density.
LENGTH = 80
#: Terms that name groups of people; the first of a row is the neutral one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "immigrants", "refugees", "foreigners", "africans", "asians", "arabs", "europeans", "americans", "mexicans", "gays", "lesbians", "seniors"),
    ("human", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "black", "white", "asian", "african", "arab", "latino", "mexican", "american", "european", "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "disabled", "blind", "deaf", "elderly", "old", "young", "female", "male", "immigrant", "refugee", "foreign"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "negros", "blancos", "gitanos", "extranjeros"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwarze", "weiße", "ausländer", "behinderte"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "noirs", "blancs", "étrangers", "handicapés"),
)

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n\r;|"]] = True


def words_by_sentence(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each distinct feature's bucket with its sentence,
    each sentence's text, and each text's words. With weights, only features that have one."""
    data = tv.LOWER[data]
    starts, ends, rows = tv.spans(tv.ALNUM[data], offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, words
    stops = np.cumsum(_STOPS[data])
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] != stops[ends[:-1] - 1])
    sentence = np.cumsum(new) - 1
    prefix = tv.Prefix(tv.BYTE_VALUES[data])
    found, where = [prefix.hash(starts, ends)], [sentence]
    for n in BEGINNINGS:
        longer = ends - starts > n
        at = starts[longer]
        found.append(prefix.hash(at, at + n) + np.uint64(n))
        where.append(sentence[longer])
    buckets, where = (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(where)
    if weights is not None:
        some = weights[buckets] > 0
        buckets, where = buckets[some], where[some]
    key = np.unique(where * BUCKETS + buckets)
    return key % BUCKETS, key // BUCKETS, rows[new], words


def bucket(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(tv.word_hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0] % np.uint64(BUCKETS))


def _pooled(weights: np.ndarray, buckets: np.ndarray, sentence: np.ndarray, doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence of each sentence, of each document's worst sentence, and of each document for its length."""
    evidence = np.bincount(sentence, weights[buckets], minlength=len(doc))
    worst = np.zeros(len(words))
    np.maximum.at(worst, doc, evidence)
    return evidence, worst, np.bincount(doc, evidence, minlength=len(words)) / (1 + words / LENGTH)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    of_worst: float
    of_density: float
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, worst, density = _pooled(self.weights, *words_by_sentence(data, offsets, self.weights))
        return 1 / (1 + np.exp(-(self.bias + self.of_worst * worst + self.of_density * density)))


def term_buckets(term: str) -> np.ndarray:
    """All features of a term: the word and its beginnings."""
    data = np.frombuffer(term.encode(), np.uint8)
    return words_by_sentence(data, np.array([0, len(data)]))[0]


def _swaps(mentions: np.ndarray, placed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each swap of two terms: features that differ, with their swap and sign, and
    the swap's share of all. mentions: sentences that have a bucket; each mention is
    swapped with all terms of its row alike. placed: sentences in which each term and
    its neutral counterpart take a word's place."""
    buckets, owner, sign, often = [], [], [], []
    for terms in IDENTITY_TERMS:
        own = [term_buckets(t) for t in terms]
        for k, one in enumerate(own):
            for j, two in enumerate(own):
                times = mentions[bucket(terms[k])] / len(terms) + placed * (j == 0)
                if j != k and times:
                    only = np.setdiff1d(one, two), np.setdiff1d(two, one)
                    for part, of in zip(only, (1.0, -1.0)):
                        buckets.append(part)
                        owner.append(np.full(len(part), len(often)))
                        sign.append(np.full(len(part), of))
                    often.append(2 * times / sum(map(len, only)))
    if not often:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    total = sum(mentions[bucket(t)] + placed for terms in IDENTITY_TERMS for t in terms)
    return np.concatenate(buckets), np.concatenate(owner), np.concatenate(sign), np.array(often) / total


def significant(ones: np.ndarray, zeros: np.ndarray, toxic: int, clean: int, surely: float = 4.0) -> np.ndarray:
    """First weights: the shrunken log odds of buckets that are significantly likelier
    in toxic documents, and 0 for others. ones, zeros: toxic and clean documents that have a bucket."""
    n1, n0 = max(1, toxic), max(1, clean)
    odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
    error = np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    expected = (ones + zeros) * n1 / (n1 + n0)
    sure = (ones - expected) / np.sqrt(np.maximum(expected, 0.1)) > surely
    return np.where(sure & (ones >= 3), np.maximum(0, odds - error), 0)


def identity_buckets() -> np.ndarray:
    return np.unique(np.concatenate([term_buckets(t) for terms in IDENTITY_TERMS for t in terms]))


def train(start: np.ndarray, seen: np.ndarray, buckets: np.ndarray, sentence: np.ndarray, doc: np.ndarray, words: np.ndarray, labels: np.ndarray, *, rounds: int = 300, rate: float = 0.3, decay: float = 1e-2, penalty: float = 1.0, placed: int = 40) -> Model:
    """start, seen: first weight and number of documents of each bucket; buckets, with a
    weight or of an identity term, and their sentence; each sentence's document; each document's words and label."""
    if not len(labels):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0)
    n1, n0 = max(1, labels.sum()), max(1, (labels == 0).sum())
    differ, swap, sign, share = _swaps(np.bincount(buckets, minlength=BUCKETS), placed if len(doc) else 0)
    kept = start > 0
    kept[differ] = True
    weights = start.copy()
    of_worst, of_density, bias = 0.5, 1.0, float(np.log(n1 / n0)) - 1
    speed, speeds = np.zeros(BUCKETS), np.zeros(3)
    for _ in range(rounds):
        evidence, worst, density = _pooled(weights, buckets, sentence, doc, words)
        z = bias + of_worst * worst + of_density * density
        slope = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        back = slope[doc] * (of_density / (1 + words[doc] / LENGTH) + of_worst * (evidence == worst[doc]))
        step = np.bincount(buckets, back[sentence], minlength=BUCKETS) + decay * (weights - start) / np.maximum(1, seen)
        gap = penalty * share * np.bincount(swap, sign * weights[differ], minlength=len(share))
        step += np.bincount(differ, sign * gap[swap], minlength=BUCKETS)
        speed = 0.9 * speed + step
        weights = np.where(kept, np.maximum(0, weights - 10 * rate * speed), 0)
        speeds = 0.9 * speeds + np.array([(slope * worst).sum(), (slope * density).sum(), slope.sum()])
        of_worst, of_density, bias = max(0, of_worst - rate * speeds[0]), max(0, of_density - rate * speeds[1]), bias - rate * speeds[2]
    return Model(weights.astype(np.float32), float(of_worst), float(of_density), float(bias))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents that have a bucket, of a task's rows; bucket -1 counts the documents."""
    sums, docs = np.zeros((2, BUCKETS), np.int64), [0, 0]
    for batch in batches:
        for part, data, offsets in tv.slices(batch):
            buckets, sentence, rows, _ = words_by_sentence(data, offsets)
            labels = part.column("label").to_numpy(zero_copy_only=False)
            key = np.unique(rows[sentence] * BUCKETS + buckets)
            for label in (0, 1):
                docs[label] += int((labels == label).sum())
                sums[label] += np.bincount((key % BUCKETS)[labels[key // BUCKETS] == label], minlength=BUCKETS)
    some = np.flatnonzero(sums.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[1][some], docs[1])), pa.array(np.append(sums[0][some], docs[0]))], ["bucket", "ones", "zeros"])


def _sentences(chosen):
    """chosen: a broadcast of buckets that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS)
        wanted[chosen.value] = 1
        for batch in batches:
            for part, data, offsets in tv.slices(batch):
                buckets, sentence, rows, words = words_by_sentence(data, offsets, wanted)
                at = np.searchsorted(rows[sentence] if len(rows) else sentence, np.arange(part.num_rows + 1))
                made = [[x[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])] for x in (buckets, sentence)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), pa.array(words, pa.int64()), *(pa.array(x, pa.binary()) for x in made)], ["doc_id", "label", "words", "buckets", "sentences"])

    return run


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """Learns from rows that aren't held out; at most sample_rows of them, one of each id. What reaches the
    driver is the number of documents of each bucket, and the features that count."""
    sample = stored(labelled_sample(documents, labels, label, sample_rows))
    sums = sample.mapInArrow(_counts, "bucket long, ones long, zeros long").groupBy("bucket").agg(F.sum("ones"), F.sum("zeros")).toArrow()
    at, ones, zeros = (c.to_numpy() for c in sums.columns)
    totals = {k: int(x[at == -1].sum()) for k, x in ((1, ones), (0, zeros))}
    both = np.zeros((2, BUCKETS), np.int64)
    both[:, at[at >= 0]] = np.stack([ones, zeros])[:, at >= 0]
    start = significant(both[0], both[1], totals[1], totals[0])
    chosen = np.union1d(np.flatnonzero(start), identity_buckets())
    spread = documents.sparkSession.sparkContext.broadcast(chosen)
    rows = sample.mapInArrow(_sentences(spread), "doc_id string, label int, words long, buckets binary, sentences binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["words"], bytes(r["buckets"])))
    buckets, sentence, doc, n = [], [], [], 0
    for k, r in enumerate(rows):
        own, inside = np.unique(np.frombuffer(r["sentences"], np.int32), return_inverse=True)
        buckets.append(np.frombuffer(r["buckets"], np.int32).astype(np.int64))
        sentence.append(inside.astype(np.int64) + n)
        doc.append(np.full(len(own), k))
        n += len(own)
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, sentence, doc)]
    return train(start, both.sum(0), *joined, *(np.array([r[c] for r in rows], np.int64) for c in ("words", "label")), **options)


def score(documents: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "score") -> DataFrame:
    """The kept columns of every row and the score of its whole text."""
    rows = documents.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))] + ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(held.value.scores(data, offsets), pa.float64())], names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["value double"])
    return rows.mapInArrow(run, schema).toDF(*keep, to)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
