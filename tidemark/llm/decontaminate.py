"""Benchmark decontamination: training token windows against a broadcast set of
normalised benchmark n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased. An item's windows are its runs of ``window`` consecutive words, or
all its words where it has fewer. A document's windows of the same lengths are
hashed in bulk; a hash that the benchmark has is then compared word by word. A
document word inside a verified window is hit.

The benchmark's windows travel to each task only while they hold at most
``broadcast_bytes``; a larger benchmark is cut into parts of that size by a hash
of the item's id, each part is scanned for in a pass of its own, and the passes'
hits are merged by document row.

Edge cases: null or empty texts have no words and no hits; items without an id are
hit but not listed; items whose text is null and items
without words have no window; a repeated item row counts once, items with equal
words each count; repeated document rows each give a row; an empty benchmark
hits nothing, and an empty table gives no rows; a very long text is scanned whole, in a
slice of its own; other columns may have any names, also those that a scan adds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import named, once, stored, table, unused

WINDOW = 13
#: Item text that is broadcast at once.
BROADCAST_BYTES = 32 << 20
#: The columns that a scan adds.
ADDED = ("n_words", "n_hit", "items", "spans")


class Windows:
    """The windows of benchmark items: by length, sorted hashes, and for each the place of
    its words in ``text``, all items' words with one space between, and its item's number."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        self.items: list[str] = []
        texts: list[bytes] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = defaultdict(list)
        place = 0
        for item, text in items:
            data = tv.LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = tv.spans(tv.ALNUM[data], np.array([0, len(data)]))
            if not len(starts):
                continue
            n = min(size, len(starts))
            raw, lengths = data.tobytes(), ends - starts
            texts.append(b" ".join([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]) + b" ")
            at = place + np.cumsum(lengths + 1) - (lengths + 1)
            hashes = tv.ngram_hashes(tv.word_hashes(data, starts, ends), n)
            until, first = (at + lengths)[n - 1 :], np.arange(len(hashes))
            if len(np.unique(hashes)) < len(hashes):  # a window that an item repeats counts once
                words = [texts[-1][i - place : j - place] for i, j in zip(at[: len(hashes)].tolist(), until.tolist())]
                first = np.array(list({w: k for k, w in enumerate(words)}.values()))
            found[n].append((hashes[first], at[first].astype(np.uint32), until[first].astype(np.uint32), len(self.items)))
            self.items.append(item)
            place += len(texts[-1])
        self.text = b"".join(texts)
        #: By length: hashes, starts, ends, items.
        self.at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in list(found):
            lists = found.pop(n)
            hashes = np.concatenate([x[0] for x in lists])
            order = np.argsort(hashes, kind="stable").astype(np.uint32)
            columns = [np.concatenate([x[k] for x in lists])[order] for k in (1, 2)]
            owner = np.repeat(np.array([x[3] for x in lists], np.uint32), [len(x[0]) for x in lists])[order]
            self.at[n] = hashes[order], *columns, owner

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """For texts laid end to end: each word's start, end, row, and whether it is hit; words by row; items by row."""
        data = tv.LOWER[data]
        starts, ends, rows = tv.spans(tv.ALNUM[data], offsets)
        n_rows = len(offsets) - 1
        items: list[set[str]] = [set() for _ in range(n_rows)]
        edges = np.zeros(len(starts) + 1, np.int32)
        hashes = tv.word_hashes(data, starts, ends)
        for n, (known, first, last, owner) in self.at.items():
            grams = tv.ngram_hashes(hashes, n)
            if not len(grams):
                continue
            whole = rows[: len(grams)] == rows[n - 1 :]
            place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            seen: dict[bytes, list[str]] = {}
            for k in np.flatnonzero(whole & (known[place] == grams)).tolist():
                words = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(k, k + n))
                if words not in seen:
                    until = int(np.searchsorted(known, grams[k], "right"))
                    seen[words] = [self.items[owner[x]] for x in range(place[k], until) if self.text[first[x] : last[x]] == words]
                if seen[words]:
                    edges[k] += 1
                    edges[k + n] -= 1
                    items[rows[k]].update(seen[words])
        return starts, ends, rows, np.cumsum(edges[:-1]) > 0, np.bincount(rows, minlength=n_rows), items


def _parts(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // limit) or 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _collected(part: DataFrame) -> list[tuple[str, str]]:
    return [(r["item"], r["text"]) for r in part.collect()]


def scan(
    documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, with_spans: bool = False, to: tuple[str, str, str, str] = ADDED,
) -> DataFrame:
    """Per document row: the kept columns, n_words, n_hit, items (sorted ids of the
    items with a window in it), and with_spans also spans, the hit character
    ranges as array<struct<start,end>> in UTF-8 bytes. to: other names for the four."""
    spark = documents.sparkSession
    rows = documents.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = _parts(benchmark, item, item_text, broadcast_bytes)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    many = len(parts) > 1
    if many:  # every pass must see the same rows under the same number
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).select("row", *rows.columns))
        fields = ["row long", *fields]
    spans = with_spans or many

    def one_pass(part: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(_collected(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = once(held.value, lambda items: Windows(items, window))
            for batch in batches:
                for piece, data, offsets in tv.slices(batch):
                    starts, ends, owner, hit, words, items = windows.scan(data, offsets)
                    n = len(offsets) - 1
                    out = [*piece.columns[:-1], pa.array(words, pa.int64()), pa.array(np.bincount(owner[hit], minlength=n), pa.int64()), pa.array([sorted(i for i in x if i is not None) for x in items], pa.list_(pa.string()))]
                    if spans:
                        found: list[list[dict]] = [[] for _ in range(n)]
                        for k in np.flatnonzero(hit).tolist():
                            found[owner[k]].append({"start": int(starts[k] - offsets[owner[k]]), "end": int(ends[k] - offsets[owner[k]])})
                        out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                    yield pa.RecordBatch.from_arrays(out, names)

        names = [f.split(" ", 1)[0] for f in fields] + ["n_words", "n_hit", "items"] + ["words_hit"] * spans
        schema = ", ".join([*fields, "n_words long, n_hit long, items array<string>"] + ["words_hit array<struct<start:int,end:int>>"] * spans)
        return rows.mapInArrow(run, schema)

    out = one_pass(parts[0])
    for part in parts[1:]:
        out = out.unionByName(one_pass(part))
    if many:
        kept = [f.split(" ", 1)[0] for f in fields[1:]]
        out = out.groupBy("row").agg(
            *[F.first(c).alias(c) for c in kept], F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("words_hit")))).alias("words_hit"),
        ).withColumn("n_hit", F.size("words_hit").cast("long")).select(*kept, "n_words", "n_hit", "items", "words_hit")
    if spans and not with_spans:
        out = out.drop("words_hit")
    return out.toDF(*keep, *to[: len(out.columns) - len(keep)])


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> F.Column:
    """The rule of the contract: at least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they are, that aren't contaminated."""
    to = tuple(unused(c, documents.columns) for c in ADDED)
    marked = scan(documents, benchmark, keep=tuple(documents.columns), to=to, **options)
    return marked.where(~contaminated(*to[:2])).select(*named(documents.columns))


def without_spans(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with the hit words cut from their texts instead; whole documents stay."""
    to = tuple(unused(c, documents.columns) for c in ADDED)
    marked = scan(documents, benchmark, keep=tuple(documents.columns), text=text, with_spans=True, to=to, **options)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        def one(t, found):
            if t is None or found is None or not len(found):
                return t
            raw, out, at = t.encode(), [], 0
            for s in found:
                out.append(raw[at : s["start"]])
                at = s["end"]
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans)])

    return marked.withColumn(text, cut(text, to[3])).select(*named(documents.columns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(documents: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by plain loops, for small tests: (doc_id, n_words, n_hit, sorted items)."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        windows += [(None if item is None else str(item), w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in documents:
        w = split(text)
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {item} - {None}
        out.append((doc, len(w), len(hit), sorted(found)))
    return out
