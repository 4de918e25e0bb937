import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest as m

DOCS = "doc_id long, source string, lang string, n_chars long, text string, node string, tree string, kept string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _root(nodes):
    while len(nodes) > 1:
        nodes = [_h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0]


def _proof(nodes, k):
    out = []
    while len(nodes) > 1:
        out += nodes[k ^ 1 : (k ^ 1) + 1]
        nodes, k = [_h(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], k // 2
    return out


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _expected(docs):
    trees = {}
    for row in docs:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: [_leaf(r) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))] for t, rows in trees.items()}
    tops = [_root(made[t]) for t in order]
    out = []
    for t in order:
        for k, node in enumerate(made[t]):
            out.append((node, _root(made[t]), _root(tops), _h(*_proof(made[t], k), *_proof(tops, order.index(t)))))
    return sorted(out)


def _made(spark, docs, height):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    rows = df.select(F.col("lang").alias("tree"), "doc_id", m.leaf(*map(F.col, df.columns)).alias("node"), F.struct("doc_id").alias("kept"))
    out = m.manifest(rows.repartition(5), "doc_id", height)
    return out.withColumn("again", m.folded(F.col("node"), F.col("steps"))).withColumn("proof", F.sha2(F.array_join(m.siblings(F.col("steps")), ""), 256)).collect()


@pytest.mark.parametrize("height", [2, 10])
def test_equals_brute_force_at_every_height(spark, height):
    sizes = {"en": 23, None: 8, "": 1, "é": 5, "z": 2}
    docs = [(7 * k if k else None, f"s{k}", lang, None if k % 4 == 1 else k, "x" * k if k % 5 else None) for lang, n in sizes.items() for k in range(n)]
    docs += docs[3:6]  # repeated rows are leaves of their own
    got = _made(spark, docs, height)
    assert sorted((r.node, r.subroot, r.root, r.proof) for r in got) == _expected(docs)
    assert all(r.again == r.root for r in got)


def test_empty_lone_and_long(spark):
    assert _made(spark, [], 3) == []
    lone = (1, None, None, None, "é" * 300_000)
    (row,) = _made(spark, [lone], 3)
    assert row.node == row.subroot == row.root == _leaf(lone) and row.steps == [] and row.proof == _h("")


def test_query_finds_what_was_changed(spark, tmp_path):
    docs = [(k if k != 20 else None, "s", "en" if k % 3 else None, k if k % 9 else None, f"text {k}", "clash", "clash", "clash") for k in range(40)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op11_merkle_manifest(spark, f"file://{tmp_path}").collect()
    plain = [d[:5] for d in docs]
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == _expected(plain)
    changed = {d[0] for d in plain if d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0}
    assert changed and {r.doc_id for r in got if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_a_block_is_the_most_that_a_task_holds(spark):
    """Levels are written by passes of ``height``, each reading the one before."""
    rows = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("node"), F.lit(0).alias("kept"))
    store = m.Manifest(rows, "k", 4)
    assert store.depth == 10
    assert [store.level(k).count() for k in range(11)] == [1000, 500, 250, 125, 63, 32, 16, 8, 4, 2, 1]
    assert store.roots().collect()[0].node == _root([hashlib.sha256(str(k).encode()).hexdigest() for k in range(1000)])
