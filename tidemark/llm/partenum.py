"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles; equal sets are one class from then on. The
feature domain (all shingles) is partitioned by a hash. Two sets of sizes s and t
with Jaccard similarity J >= gamma differ in at most D = (s + t)(1 - gamma)/(1 +
gamma) shingles, so they differ in at most D parts, and agree in the rest. Of its
non-empty parts, in the parts' order, a set takes the first D + q and enumerates
their subsets of q parts: each is a signature, and similar sets share one. (The
q-th part on which both agree comes after at most D parts on which they don't, so
both have it among their first D + q. A set with fewer parts enumerates smaller
subsets too, down to the empty one.) q is 2 for small sets and 1 for large ones.
The partition is as fine as a size band needs. A band's greatest size is twice its
least, and a set signs for its own band, and for the one below if partners may lie
there, so every possible partner meets it.

Sets take a few parts more than that, so similar ones share more than one, and only
pairs that share as many as they must are compared: by sketches (parity bits of the
shingles, which never part similar sets), then exactly.

Up to GROUP sets of a signature give all their pairs. Of a larger group, each set is
paired with the smallest only, so pairs are at most a few times the sets. Where a
large group still has sets of several components, a pair may have shared more than was
counted: pairs are compared, too, that share enough together with the large groups
that both may be in. Sets that are in so many of them that a pair may share nothing
else sign again, with parts whose signatures those groups withdraw. (The argument
above holds for any parts that both sets leave out alike.) What remains after ROUNDS
of it goes to a last, exact stage: sets are joined on their rarest shingles (counted
over these sets), as many as a similar pair can't all miss, if their places leave room
for enough common ones. Where shingles are crowded, each set is compared with a few of
its shingles' sets first, and only pairs of components that are still apart are joined
after that. So no link between different components is lost, and no group is expanded
into all its pairs.

Sizes, hashes and ids alone travel in the first stage; sketches and shingles are made
again for the sets that have a candidate.

Edge cases: a text of fewer words than ``words`` is one shingle of all its words;
texts without words, and null texts, have no set, link with nothing, and are their
own component; equal sets link even when texts differ; a very long text is one set
like any other, made at once in a task; a null doc_id links like any other but a
component's id is its least non-null doc_id; repeated rows each give a row; an empty
table gives no rows; only the named columns are read, and ``one_of_each`` returns all
others as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_folder, named, scratch, semi, small_enough, stored, table, unused
from .components import components

WORDS, PERCENT = 5, 75
#: Sets of a signature that are compared pairwise.
GROUP = 8
#: Rounds of signing, each without the signatures that the ones before withdrew.
ROUNDS = 2
#: Withdrawn signatures (8 bytes each) that are broadcast; with more, the last stage takes over at once.
WITHDRAWN = 4_000_000
#: In the last stage, with how many sets of a crowded shingle each of its sets is compared first.
CHOSEN = 2
#: Up to so many differing shingles, signatures take two parts each.
PAIRED = 8
#: One part more for so many differing shingles: as many more must agree, too.
SPARE = 8


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Of texts laid end to end: each text's distinct shingles' hashes, sorted."""
    data = tv.LOWER[data]
    starts, ends, rows = tv.spans(tv.NOT_SPACE[data], offsets)
    hashes = tv.word_hashes(data, starts, ends)
    grams = tv.ngram_hashes(hashes, words)
    cut = np.searchsorted(rows, np.arange(len(offsets))).tolist()
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= words:
            found = np.sort(grams[a : b - words + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        else:
            out.append(tv.ngram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of hashed shingles, eight to sixteen bits for each. Sets that differ in d
    shingles have sketches that differ in d bits at most, also after folding the longer one."""
    bits = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    at = (tv.mix(shingles + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit id of a set: equal for equal sets."""
    total = np.array([tv.mix(shingles).sum(dtype=np.uint64)])
    return int(tv.mix(total + np.uint64(len(shingles))).view(np.int64)[0])


class Bands:
    """Size bands, each up to ``ratio`` times as wide as its least size, and the partitions of the bands' instances."""

    def __init__(self, percent: int):
        self.percent, self.ratio = percent, max(2, -(-100 // percent))
        self.low, self.high = [1], [self.ratio - 1]
        self.far = 100 - percent, 100 + percent

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.ratio - 1)
        return int(np.searchsorted(self.high, size))

    def roles(self, size: int) -> list[tuple[int, int]]:
        """The instances a set of this size signs for, and how many shingles it may differ in there:
        its own band's, and that of the band below where a partner may lie there."""
        band = self.of(size)
        roles = [(band, (size + size * 100 // self.percent) * self.far[0] // self.far[1])]
        if band and self.high[band - 1] * 100 >= self.percent * size:
            roles.append((band - 1, (size + self.high[band - 1]) * self.far[0] // self.far[1]))
        return roles

    def paired(self, instance: int) -> bool:
        """Whether the instance enumerates pairs of parts."""
        return (2 * self.low[instance] * 100 // self.percent) * self.far[0] // self.far[1] <= PAIRED

    def parts(self, instance: int) -> int:
        """Parts of an instance: few, but nearly always more non-empty ones than shingles may differ and agree at least."""
        low = self.low[instance]
        return 8 * low if self.paired(instance) else int(low * self.ratio * 3.15 * self.far[0] / self.far[1] + 2 * low**0.5) + 1


def signatures(shingles: np.ndarray, bands: Bands, withdrawn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of hashes, and for each its mark: twice the number of
    signatures that a partner has to share, plus 1 in the upper role."""
    out, marks = [], []
    spread = tv.mix(shingles)
    for instance, far in bands.roles(len(shingles)):
        if far == 0:
            continue  # only an equal set would do
        upper = instance != bands.of(len(shingles))
        n, salt = bands.parts(instance), np.uint64(0x9E3779B97F4A7C15 * (2 * instance + 3) % (1 << 64))
        part = (spread >> np.uint64(20)) % np.uint64(n)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums = tv.mix(np.add.reduceat(spread[order], first) + tv.mix(part[first] + salt))
        if withdrawn is not None and len(withdrawn) and not bands.paired(instance):
            short = sums >> np.uint64(_MARK)
            at = np.minimum(np.searchsorted(withdrawn, short), len(withdrawn) - 1)
            sums = sums[withdrawn[at] != short]
        q, need = (2, 1) if bands.paired(instance) else (1, max(1, min(1 + far // SPARE, len(sums) - far)))
        while True:
            chosen = sums[: far + q + need - 1]
            if q == 2:
                at = np.array(list(combinations(range(len(chosen)), 2)), np.int64).reshape(-1, 2)
                out.append(tv.mix(chosen[at[:, 0]] * np.uint64(3) + chosen[at[:, 1]]))
            else:
                out.append(chosen if q else np.array([salt]))
            marks.append(np.full(len(out[-1]), 2 * need + upper, np.int16))
            if len(sums) >= far + q or q == 0:
                break
            q -= 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int16)
    return np.concatenate(out), np.concatenate(marks)


def _info(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tv.slices(batch):
                found = sets(data, offsets, words)
                sizes = np.array([len(x) for x in found], np.int64)
                ids = pa.array([set_id(x) if len(x) else None for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), ids], ["doc_id", "text_id", "n_shingles", "set_id"])

    return run


#: A shuffled signature holds 48 bits of the hash above 16 bits of mark: a false match among 10^13 is rare and harmless.
_MARK = 16


def _signed(words: int, percent: int, withdrawn=None):
    """withdrawn: a broadcast of sorted signatures, as ``_grouped`` tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, data, offsets in tv.slices(batch):
                found, owner = [], []
                for shingles in sets(data, offsets, words):
                    if not len(shingles) or (own := set_id(shingles)) in seen:
                        continue  # one of equal sets signs for them, at least within a task
                    seen.add(own)
                    sigs, mark = signatures(shingles, bands, withdrawn.value if withdrawn else None)
                    found.append(sigs >> np.uint64(_MARK) << np.uint64(_MARK) | mark.astype(np.uint64))
                    owner.append(np.full(len(sigs), own, np.int64))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owner))], ["sig", "id"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    """Rows (sig, id, mark) come sorted by signature and id; groups end anywhere
    between batches. Yields candidate pairs (a, b) with the number n of signatures seen
    to be shared and how many they need to share; and, of groups over ``group``, the
    members (as a) with their signature in ``hot`` and the number they need to share."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)]  # of the last group so far
    overflow = False

    def told(pairs: list, hot: list) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b, x, y = (np.concatenate(c) for c in zip(*pairs))
            use = ((x & y) & 1) == 0  # a pair in the upper role meets in its own band, too
            a, b, need = a[use], b[use], np.minimum(x[use] >> 1, y[use] >> 1)
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n.astype(np.int32)), pa.array(need[first].astype(np.int32)), pa.nulls(len(first), pa.int64())], names)
        if hot:
            sig, ids, x = (np.concatenate(c) for c in zip(*hot))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int32()), pa.array((x >> 1).astype(np.int32)), pa.array(sig)], names)

    names = ["a", "b", "n", "need", "hot"]
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, ids, mark = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]))
        sig, ids, mark = sig[fresh], ids[fresh], mark[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        pairs, hot = [], []
        for g in range(2, group + 1):
            at = starts[:-1][sizes[:-1] == g]
            at = at[at > 0] if overflow else at
            if len(at):
                for i, j in combinations(range(g), 2):
                    pairs.append((ids[at + i], ids[at + j], mark[at + i], mark[at + j]))
        for k in np.flatnonzero((sizes > group) | (np.arange(len(sizes)) == 0) & overflow).tolist():
            lo, hi = starts[k], starts[k] + sizes[k]
            again = overflow and k == 0  # the first one was told before
            if hi - lo > 1:
                pairs.append((np.full(hi - lo - 1, ids[lo]), ids[lo + 1 : hi], np.full(hi - lo - 1, mark[lo]), mark[lo + 1 : hi]))
            hot.append((sig[lo + again : hi], ids[lo + again : hi], mark[lo + again : hi]))
        overflow = bool(sizes[-1] > group or overflow and len(sizes) == 1)
        keep = slice(starts[-1], starts[-1] + 1 if overflow else None)
        held = [sig[keep], ids[keep], mark[keep]]
        yield from told(pairs, hot)
    _, ids, mark = held
    if len(ids) > 1 and not overflow:
        yield from told([(ids[[i]], ids[[j]], mark[[i]], mark[[j]]) for i, j in combinations(range(len(ids)), 2)], [])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for _, data, offsets in tv.slices(batch):
                found = [x for x in sets(data, offsets, words) if len(x)]
                made = [pa.array([set_id(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([sketch(x) for x in found], longs), pa.array([x.view(np.int64) for x in found], longs)]
                yield pa.RecordBatch.from_arrays(made, ["id", "size", "sketch", "shingles"])

    return run


def _beside(pairs: DataFrame, sets_: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with their sets' sizes (size_a, size_b) and values (x, y)."""
    one = sets_.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col(value).alias("x"))
    two = sets_.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col(value).alias("y"))
    return pairs.join(one, "a").join(two, "b")


def _near(n: F.Column, m: F.Column, x: F.Column, y: F.Column, percent: int) -> F.Column:
    """Whether sizes n, m and sketches x, y leave it open that the sets are similar; true for every similar pair."""
    short = F.least(F.size(x), F.size(y))

    def folded(c: F.Column) -> F.Column:
        return F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), lambda u, v: u.bitwiseXOR(v))).otherwise(c)

    apart = F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, k: total + k)
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _plausible(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Pairs without those whose sizes or sketches show that the sets differ too much."""
    both = _beside(pairs, sets_, "sketch")
    return both.where(_near(F.col("size_a"), F.col("size_b"), F.col("x"), F.col("y"), percent)).select(*pairs.columns)


def _verified(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    common = F.size(F.array_intersect("x", "y"))
    return _beside(pairs, sets_, "shingles").where(100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)).select("a", "b")


def _postings(sets_: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, n, rank) of these sets' rarest shingles. Complete: of the common shingles of a
    similar pair, the first in the order of rarity has room behind it, in both sets, for all the others they need."""
    rows = sets_.select("id", F.col("size").alias("n"), F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = rows.join(counts, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")))
    taken = ranked.where("df > 1").where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return taken.select("shingle", "id", "n", "rank")


def _mixed(postings: DataFrame) -> DataFrame:
    """Postings (shingle, id, n, rank, root) without shingles of one component only, which have nothing to join."""
    mixed = postings.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle")
    return postings.join(mixed, "shingle", "left_semi")


def _crowded(postings: DataFrame) -> bool:
    """Whether pairs of different components that share a shingle are more than GROUP times the postings."""
    of_root = postings.groupBy("shingle", "root").agg(F.count("*").cast("double").alias("k"))
    of_shingle = of_root.groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    total = of_shingle.agg(F.sum("k").alias("n"), F.sum((F.col("k") * F.col("k") - F.col("own")) / 2).alias("pairs")).first()
    return total["n"] is not None and total["pairs"] > GROUP * total["n"]


def _room(percent: int) -> F.Column:
    """Whether two postings' places leave room for as many common shingles as their sets need."""
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    return 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) >= needed


def _sides(left: DataFrame, right: DataFrame) -> list[DataFrame]:
    return [df.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "shingle"]) for df, k in ((left, "a"), (right, "b"))]


def _with_chosen(postings: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components: each posting with CHOSEN others of its shingle, those of the most room (then by a hash)."""
    first = [F.min(F.struct("rank", F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "root")).alias(f"c{k}") for k in range(CHOSEN)]
    chosen = postings.groupBy("shingle").agg(*first).select("shingle", F.explode(F.array(*[f"c{k}" for k in range(CHOSEN)])).alias("c"))
    left, right = _sides(postings, chosen.select("shingle", "c.id", "c.n", "c.rank", "c.root"))
    met = left.join(right, "shingle").where((F.col("root_a") != F.col("root_b")) & _room(percent))
    return _plausible(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), sets_, percent)


def _across(postings: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components among these sets, joined on their rarest shingles."""
    taken = postings.join(sets_.select("id", "sketch"), "id")
    left, right = _sides(taken, taken)
    near = _near(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), percent)
    met = left.join(right, "shingle").where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & _room(percent) & near)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


class _Join:
    """The components that the links found so far make."""

    def __init__(self, documents: DataFrame, info: DataFrame, words: int, percent: int):
        self.documents, self.info, self.words, self.percent = documents, info, words, percent
        self.spark = documents.sparkSession
        self.roots: DataFrame | None = None
        #: Links that the next ones take along into the components.
        self.waiting: DataFrame | None = None
        self.folders: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        at = scratch(self.spark)
        out = stored(df, at)
        self.folders.append((out, at))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes stored tables that nothing reads any more."""
        for df, at in self.folders:
            if any(df is x for x in tables):
                drop_folder(self.spark, at)
        self.folders = [x for x in self.folders if not any(x[0] is t for t in tables)]

    def root(self, df: DataFrame, column: str, to: str) -> DataFrame:
        if self.roots is None:
            return df.withColumn(to, F.col(column))
        roots = self.roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
        return df.join(roots, column, "left").withColumn(to, F.coalesce("_root", column)).drop("_root")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different components."""
        return pairs if self.roots is None else self.root(self.root(pairs, "a", "_a"), "b", "_b").where("_a != _b").drop("_a", "_b")

    def texts(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Texts of one document of each of these sets, and the stored ids of those documents, which they need."""
        first = self.info.join(ids.withColumnRenamed("id", "set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
        first = self.stored(first.select("rep"))  # counted and then read: not made twice
        small = F.broadcast(first) if small_enough(first) else first
        return self.documents.join(small, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text"), first

    def made(self, ids: DataFrame) -> DataFrame:
        """(id, size, sketch, shingles) of these sets, and perhaps of others; stored."""
        texts, first = self.texts(ids)
        made = self.stored(texts.mapInArrow(_sets(self.words), "id long, size int, sketch array<long>, shingles array<long>"))
        self.drop(first)
        counts = made.select("id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
        if counts["n"] == counts["d"]:
            return made
        once = self.stored(made.dropDuplicates(["id"]))
        self.drop(made)
        return once

    def compare(self, pairs: DataFrame, *, later: bool = False) -> None:
        """Joins the components of the similar ones of these pairs (a, b); later: with the next ones' only."""
        if pairs.isEmpty():
            return
        sets_ = self.made(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        left = self.stored(self.across(_plausible(pairs, sets_, self.percent)))
        used = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
        found = self.stored(_verified(left, sets_.join(used, "id", "left_semi"), self.percent))
        self.drop(left, sets_)
        if later:
            self.waiting = found
        else:
            self.join(found)

    def join(self, links: DataFrame | None = None) -> None:
        """Joins components by stored links between them, and by those that wait: only their roots take part."""
        given = [x for x in (links, self.waiting) if x is not None]
        self.waiting = None
        some = [x for x in given if not x.isEmpty()]
        if some:
            self._join(some[0] if len(some) == 1 else some[0].unionByName(some[1]))
        self.drop(*given)

    def _join(self, links: DataFrame) -> None:
        between = self.root(self.root(links, "a", "_a"), "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        moved, old = self.stored(components(between)), self.roots
        new = moved.select(F.col("node").alias("id"), "root")
        if old is not None:
            kept = old.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left")
            new = kept.select("id", F.coalesce("_new", "root").alias("root")).unionByName(new)
        self.roots = self.stored(new)
        self.drop(moved, old)

    def mixed(self, hot: DataFrame) -> DataFrame:
        """(id, sig, many, few) of large groups (id, sig, need) of several components: of how many such
        groups the set is a member, and the least number of signatures that a pair in one of them needs to share."""
        groups = self.root(hot, "id", "root").groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("need").alias("few")).where("low != high")
        few = self.stored(groups.select("sig", "few"))
        left = self.stored(hot.select("id", "sig").join(F.broadcast(few) if small_enough(few) else few, "sig"))
        of_set = left.groupBy("id").agg(F.count("*").alias("many"), F.min("few").alias("few"))
        out = self.stored(left.select("id", "sig").join(of_set, "id"))
        self.drop(few, left)
        return out

    def sign(self, texts: DataFrame, withdrawn=None) -> DataFrame:
        """Signs the texts' sets and compares what has to be; returns (id, sig) of large groups of
        several components, of sets that may have a partner which shares nothing else with them."""
        group, mark = GROUP, F.lit((1 << _MARK) - 1)
        signed = texts.mapInArrow(_signed(self.words, self.percent, withdrawn), "sig long, id long").repartition(F.shiftright("sig", _MARK))
        signed = signed.select(F.shiftright("sig", _MARK).alias("sig"), "id", F.col("sig").bitwiseAND(mark).cast("short").alias("mark"))
        met = self.stored(signed.sortWithinPartitions("sig", "id").mapInArrow(lambda batches: _grouped(batches, group), "a long, b long, n int, need int, hot long"))
        pairs = self.stored(met.where("hot is null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")))
        self.compare(pairs.where("n >= need").select("a", "b"))
        hot = self.stored(met.where("hot is not null").select(F.col("a").alias("id"), F.col("hot").alias("sig"), "need"))
        self.drop(met)
        mixed = self.mixed(hot)
        many = self.stored(mixed.select("id", "many").distinct())
        more = pairs.where("n < need").join(many.select(F.col("id").alias("a"), F.col("many").alias("many_a")), "a").join(many.select(F.col("id").alias("b"), F.col("many").alias("many_b")), "b")
        more = self.stored(more.where(F.col("n") + F.least("many_a", "many_b") >= F.col("need")).select("a", "b"))
        self.compare(more, later=True)
        rest = self.stored(mixed.where("many >= few").select("id", "sig"))
        self.drop(pairs, hot, mixed, many, more)
        return rest

    def linking(self, pairs: DataFrame, sets_: DataFrame) -> None:
        """Joins the components of the similar ones of these pairs (a, b) of sets."""
        pairs = self.stored(pairs)
        self.join(self.stored(_verified(pairs, sets_, self.percent)))
        self.drop(pairs)

    def last(self, ids: DataFrame) -> None:
        """Joins the components of all similar ones of these sets. Where shingles are crowded, sets are first compared
        with a few others of their shingles, so that large components don't meet with each of their pairs."""
        made = self.made(ids)
        sets_ = made.join(ids, "id", "left_semi")
        postings = self.stored(_postings(sets_, self.percent))
        mixed = self.stored(_mixed(self.root(postings, "id", "root")))
        if _crowded(mixed):
            self.linking(_with_chosen(mixed, sets_, self.percent), sets_)
            self.drop(mixed)
            mixed = self.stored(_mixed(self.root(postings, "id", "root")))
        self.linking(_across(mixed, sets_, self.percent), sets_)
        self.drop(mixed, made, postings)

    def run(self) -> None:
        rest, withdrawn = self.sign(self.documents.select("text")), np.zeros(0, np.uint64)
        for _ in range(1, ROUNDS):
            sigs = rest.select("sig").distinct()
            n = sigs.count()
            if not n or n + len(withdrawn) > WITHDRAWN:
                break
            withdrawn = np.union1d(withdrawn, np.array([r[0] for r in sigs.toLocalIterator()], np.int64).view(np.uint64) & np.uint64((1 << 64 - _MARK) - 1))
            texts, first = self.texts(rest.select("id"))
            again = self.sign(texts, self.spark.sparkContext.broadcast(withdrawn))
            self.drop(rest, first)
            rest = again
        self.join()
        ids = self.stored(rest.select("id").distinct())
        if not ids.isEmpty():
            self.last(ids)
        self.drop(rest, ids)


def _named(documents: DataFrame, text: str, doc_id: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, text_id, n_shingles, set_id) of each row, and (set_id, root, least) of each set: its component, and its least doc_id."""
    documents = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    info = stored(documents.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(_info(words), f"doc_id {kind}, text_id long, n_shingles long, set_id long"))
    join = _Join(documents, info, words, percent)
    join.run()
    classes = info.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets_ = stored(join.root(classes, "set_id", "root"))
    join.drop(join.roots)
    return info, sets_


def linked(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, set_id (null without words), component_id."""
    info, sets_ = _named(documents, text, doc_id, words, percent)
    smallest = sets_.groupBy("root").agg(F.min("least").alias("component_id"))
    out = info.join(stored(sets_.join(smallest, "root").select("set_id", "component_id")), "set_id", "left")
    return out.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, but of each component only one row: that
    with the least doc_id (nulls last; then by the text's hash). Texts without words link
    with nothing and stay, but rows that agree in doc_id and text stay once (with a null doc_id, all of those)."""
    info, sets_ = _named(documents, text, doc_id, words, percent)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    first = info.join(sets_.select("set_id", "root"), "set_id").groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_id")
    kept = stored(first.unionByName(info.where("set_id is null").select("doc_id", "text_id")).distinct())
    own = unused("_text_id", documents.columns)
    rows = documents.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    is_kept = rows[doc_id].eqNullSafe(kept["doc_id"]) & (rows[own] == kept["text_id"])
    rows = rows.join(F.broadcast(kept) if small_enough(kept) else kept, is_kept, "left_semi")
    several = info.join(kept, info["doc_id"].eqNullSafe(kept["doc_id"]) & (info["text_id"] == kept["text_id"]), "left_semi").groupBy("doc_id", "text_id").count().where("count > 1")
    if several.limit(1).count():
        number, wordless = unused("_number", documents.columns), F.col(doc_id).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(doc_id, own).orderBy(own))).where((F.col(number) == 1) | wordless)
    return rows.select(*named(documents.columns))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(rows: list[tuple], words: int = WORDS, percent: int = PERCENT) -> dict:
    """(n_shingles, component_id) by doc_id, by comparing all pairs; for small tests."""
    import re

    made = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        made[doc] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in made}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(made, 2):
        x, y = made[a], made[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in made.items()}
