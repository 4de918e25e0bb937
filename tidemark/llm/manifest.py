"""Merkle dataset manifest: one root for a dataset, and for every row a short proof.

Each row is a leaf. The leaves of a tree (a language) ascend in order; while several nodes
remain, every two consecutive ones (the last alone, if it has no partner) become the hash
of their texts. The trees' roots, in order of the trees, make the dataset's root likewise.

The nodes live outside of memory, in Parquet partitioned by level:

- Leaf runs: rows are dealt by ranges of (tree, order), sorted and written once. A leaf's
  coordinate is its place in its run and the count of the runs before it, so nothing is
  numbered in one task.
- A pass reads one level in order and writes the ``HEIGHT`` levels above it. A task gets
  whole blocks of 2^HEIGHT consecutive nodes and holds one block; the next pass reads the
  last level written. N leaves take log2(N) / HEIGHT passes.
- Proofs are extracted from the top down. A scan merges a block's stored nodes, ordered by
  coordinate, with the proof of the block's own root, which the scan above has made; it
  holds one block. No leaf is joined with its log2(N) siblings.

A proof is an array with one step for each level: ``<`` and the hash of a sibling on the
left, ``>`` and that of one on the right, or an empty text where a node had none.

Edge cases: nulls of any column have a mark of their own in the leaf, and a null tree comes
first; leaves of equal order go by their hash, and repeated rows are leaves of their own;
a lone leaf is its tree's root, and a lone tree's root is the dataset's; an empty table has
no rows; texts of any length are hashed whole; columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Levels that a pass writes; a task holds 2^HEIGHT nodes and those above them.
HEIGHT = 10


def field(value: Column) -> Column:
    """A value in a leaf: its bytes' number, a colon, itself; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _parent(nodes: list[str], k: int) -> str:
    return hashlib.sha256("".join(nodes[k : k + 2]).encode()).hexdigest()


def _levels(total: Column) -> Column:
    """The level of the root above so many leaves: the bits of total - 1."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """(tree, pos, total, node, kept) of rows (tree, order, node, kept): each tree's rows
    numbered from 0 by order (nulls first), then node."""
    rows = stored(rows)  # else the ranges' sample would read and hash every text a second time
    dealt = rows.repartitionByRange("tree", order, "node").sortWithinPartitions("tree", order, "node")
    runs = stored(dealt.select("tree", "node", "kept", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place")))
    counts = stored(runs.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    runs_before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    starts = counts.select(F.col("tree").alias("t"), F.col("run").alias("r"), (F.coalesce(F.sum("n").over(runs_before), F.lit(0)) - F.col("first")).alias("offset"))
    totals = counts.groupBy(F.col("tree").alias("of")).agg(F.sum("n").alias("total"))
    starts = stored(starts.join(totals, F.col("t").eqNullSafe(F.col("of"))).drop("of"))
    placed = runs.join(starts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("r")))
    return placed.select("tree", (F.col("place") + F.col("offset")).alias("pos"), "total", "node", "kept")


def _above(height: int):
    """Whole blocks of a level's nodes, in order, to the nodes of the levels above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, out = None, [], []

        def finish() -> None:
            if now is None:
                return
            tree, block, total, base = now
            size, own = -(-total // 2**base), nodes
            for k in range(1, height + 1):
                if size == 1:
                    break
                own, size = [_parent(own, j) for j in range(0, len(own), 2)], -(-size // 2)
                first = block << (height - k)
                out.extend((tree, first + j, total, node, base + k) for j, node in enumerate(own))

        for batch in batches:
            for tree, pos, total, node, base in zip(*(c.to_pylist() for c in batch.columns)):
                key = (tree, pos >> height, total, base)
                if key != now:
                    finish()
                    now, nodes = key, []
                    if len(out) > 4000:
                        yield _batch(out, _NODES)
                        out = []
                nodes.append(node)
        finish()
        if out:
            yield _batch(out, _NODES)

    return run


_NODES = (("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("node", pa.string()), ("level", pa.int32()))


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


class Manifest:
    """The node store of rows (tree, order, node, kept), tree being a text. ``kept`` travels
    along with a leaf."""

    def __init__(self, rows: DataFrame, order: str, height: int = HEIGHT):
        self.spark, self.height = rows.sparkSession, height
        self.leaves = stored(numbered(rows, order))
        self.depth = self.leaves.agg(F.coalesce(F.max(_levels(F.col("total"))), F.lit(0))).first()[0]
        self.at = scratch(self.spark)
        base = 0
        while base < self.depth:
            block = F.shiftright("pos", height)
            level = self.level(base).withColumn("level", F.lit(base)).withColumn("block", block)
            dealt = level.repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", "pos").drop("block")
            made = dealt.mapInArrow(_above(height), "tree string, pos long, total long, node string, level int")
            made.write.partitionBy("level").mode("append").parquet(self.at)
            base += height

    def level(self, k: int) -> DataFrame:
        """(tree, pos, total, node) of a level that some tree has."""
        if k == 0:
            return self.leaves.select("tree", "pos", "total", "node")
        return self.spark.read.schema("tree string, pos long, total long, node string").parquet(f"{self.at}/level={k}")

    def roots(self) -> DataFrame:
        """(tree, node, total) of every tree."""
        tops = [self.level(k).where(_levels(F.col("total")) == k) for k in range(self.depth + 1)]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out.select("tree", "node", "total")

    def proofs(self, tops: DataFrame) -> DataFrame:
        """(tree, node, kept, steps, subroot, root) of every leaf. tops: (tree, total, steps,
        subroot, root), the proofs of the trees' roots."""
        h = self.height
        empty = F.lit(None)
        above = None
        for base in range(max(0, (self.depth - 1) // h) * h, -1, -h):
            levels = F.col("level_of")
            ends = tops.withColumn("level_of", _levels(F.col("total"))).where((levels > base) & (levels <= base + h) | (levels == 0) & F.lit(base == 0))
            ups = ends.select("tree", F.lit(0).cast("long").alias("pos"), "total", "steps", "subroot", "root")
            ups = ups if above is None else ups.unionByName(above)
            scan = ups.select("tree", F.col("pos").alias("block"), F.lit(h).alias("level"), F.lit(0).cast("long").alias("pos"), "total", empty.cast("string").alias("node"), empty.cast(self.leaves.schema["kept"].dataType).alias("kept"), "steps", "subroot", "root")
            for k in range(min(h, max(self.depth - base, 1))):
                nodes = self.leaves if base + k == 0 else self.level(base + k).withColumn("kept", empty).where(_levels(F.col("total")) > base + k)
                kept = F.col("kept").cast(self.leaves.schema["kept"].dataType)
                scan = scan.unionByName(nodes.select(
                    "tree", F.shiftright("pos", h - k).alias("block"), F.lit(k).alias("level"), "pos", "total", "node", kept.alias("kept"),
                    empty.cast("array<string>").alias("steps"), empty.cast("string").alias("subroot"), empty.cast("string").alias("root"),
                ))
            dealt = scan.repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")
            kind = dict(self.leaves.dtypes)["kept"]
            found = dealt.mapInArrow(_extracted(h, base), f"tree string, pos long, total long, node string, kept {kind}, steps array<string>, subroot string, root string")
            above = stored(found.drop("node", "kept")) if base else found
        return above.drop("pos", "total")


def _extracted(height: int, base: int):
    """Blocks of stored nodes, each behind its own root's proof and from the top level down,
    to the proofs of its lowest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, up, levels, out, kept_type = None, None, {}, [], None
        for batch in batches:
            kept_type = batch.schema.field("kept").type
            fields = (("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("node", pa.string()), ("kept", kept_type), ("steps", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string()))
            pending: list[tuple] = []
            for tree, block, level, pos, total, node, kept, steps, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, block) != key:
                    out.extend(_steps(key, up, levels, height, base))
                    key, up, levels = (tree, block), None, {}
                if level == height:
                    up = (total, steps, subroot, root)
                else:
                    levels.setdefault(level, []).append((pos, node, kept))
                if len(out) >= 2000:
                    pending, out = out, []
                    yield _batch(pending, fields)
        out.extend(_steps(key, up, levels, height, base))
        if out:
            yield _batch(out, fields)

    return run


def _steps(key, up, levels: dict, height: int, base: int) -> Iterator[tuple]:
    if key is None:
        return
    if up is None:
        raise ValueError(f"the node store holds no proof for block {key}")
    (tree, block), (total, upper, subroot, root) = key, up
    top = (total - 1).bit_length()
    own = {k: [node for _, node, _ in nodes] for k, nodes in levels.items()}
    for pos, node, kept in levels.get(0, ()):
        steps = []
        for k in range(min(height, top - base)):
            sibling = (pos >> k ^ 1) - (block << (height - k))
            there = sibling < len(own[k])
            steps.append((("<" if pos >> k & 1 else ">") + own[k][sibling]) if there else "")
        yield tree, pos, total, node, kept, [*steps, *upper], subroot, root


def manifest(rows: DataFrame, order: str, height: int = HEIGHT) -> DataFrame:
    """Rows (tree, order, node, kept) with their tree's root, the dataset's root and their
    proof: (tree, node, kept, steps, subroot, root)."""
    trees = Manifest(rows, order, height)
    subroots = stored(trees.roots())
    whole = F.lit("")
    over = Manifest(subroots.select(whole.alias("tree"), F.col("tree").alias("order"), "node", F.struct("tree", "total").alias("kept")), "order", height)
    tops = over.roots().select("tree", "total", F.array().cast("array<string>").alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    of_trees = stored(over.proofs(tops).select("kept.tree", "kept.total", "steps", F.col("node").alias("subroot"), "root"))
    return trees.proofs(of_trees)


def folded(node: Column, steps: Column) -> Column:
    """The root that a leaf and its proof's steps make."""

    def step(at: Column, s: Column) -> Column:
        other = F.substring(s, F.lit(2), F.length(s))
        return F.sha2(F.when(s == "", at).when(s.startswith("<"), F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(steps, node, step)


def siblings(steps: Column) -> Column:
    return F.transform(F.filter(steps, lambda s: s != ""), lambda s: F.substring(s, F.lit(2), F.length(s)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    due = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(parts)]
    node = leaf(*parts)
    rows = docs.select(F.col("lang").alias("tree"), "doc_id", node.alias("node"), F.struct("doc_id", F.when(due, leaf(*tampered)).alias("presented")).alias("kept"))
    out = manifest(rows, "doc_id")
    out = out.withColumn("folded_root", folded(F.coalesce("kept.presented", "node"), F.col("steps")))
    return out.select(
        "kept.doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings(F.col("steps")), ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), F.size("steps").alias("n_steps"),
    )
