import os
import random

import pytest

from tidemark.llm import lm_scoring as m


def _rows():
    r = random.Random(2)
    return [(k, " ".join(r.choice(["the", "cat", "dog", "ran", "sat", "É", "x1"][: 3 + k % 5]) for _ in range(r.randrange(60)))) for k in range(40)] + [(41, None), (42, ""), (43, "!!"), (44, "new words only here"), (44, "new words only here")]


@pytest.mark.parametrize("target,vocabulary", [({k for k in range(40) if k % 5 == 0}, 2048), (set(), 2048), (set(range(50)), 2048), ({1, 6, 11}, 6)])
def test_equals_brute_force(spark, target, vocabulary):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", m.F.lit("clash"))
    ids = spark.createDataFrame([(t,) for t in target], "doc_id long")
    got = sorted((r.doc_id, r.n_words, round(r.difference, 4)) for r in m.score(docs, m.fit(docs, ids, vocabulary=vocabulary)).collect())
    assert got == [(d, n, pytest.approx(x, abs=2e-4)) for d, n, x in sorted(m.brute_force(rows, target, vocabulary))]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.score(docs, m.fit(docs, docs.select("doc_id"))).count() == 0


def test_like_the_target_scores_lower(spark):
    rows = [(k, "alpha beta gamma " * 10) for k in range(10)] + [(k, "one two three " * 10) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(0,), (1,)], "doc_id long")
    got = {r.doc_id: r.difference for r in m.score(docs, m.fit(docs, ids)).collect()}
    assert max(got[k] for k in range(10)) < min(got[k] for k in range(10, 20))


@pytest.mark.parametrize("held,size", [(1, 1), (7, 60), (50, 1 << 20), (5_000_000, 300)])
def test_all_words_count(spark, monkeypatch, held, size):
    """All words keep their own counts, in counted documents and in others, however batches and parts are cut."""
    monkeypatch.setattr(m, "HELD_WORDS", held)
    monkeypatch.setattr(m, "PART_BYTES", size)
    monkeypatch.setattr(m.tv, "SLICE_BYTES", 100)
    rows = _rows() + [(50, "rare pair the rare pair"), (51, "rare cat once"), (None, "rare pair"), (52, "cat rare pair")]
    target = {0, 5, 10, 50}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(t,) for t in target], "doc_id long")
    fitted = m.fit(docs, ids)
    want = sorted((str(d), n, x) for d, n, x in m.brute_force(rows, target))
    for scored in (docs, docs.where("doc_id is null or doc_id >= 0").repartition(2)):  # the second isn't the counted table
        got = sorted((str(r.doc_id), r.n_words, r.difference) for r in m.score(scored, fitted).collect())
        assert got == [(d, n, pytest.approx(x, abs=2e-4)) for d, n, x in want]
    unseen = spark.createDataFrame([(1, "never seen"), (2, "rare never")], "doc_id long, text string")
    assert m.score(unseen, fitted).count() == 2


def test_rarer_words_tell_documents_apart(spark):
    """More words than the frequent ones: documents that differ only in rare words score apart."""
    common = " ".join(f"c{k} c{k} c{k} c{k}" for k in range(2100))
    rows = [(0, common), (1, "alpha beta"), (2, "alpha beta"), (3, "gamma delta"), (4, "gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.difference for r in m.score(docs, m.fit(docs, spark.createDataFrame([(1,)], "doc_id long"))).collect()}
    assert got[1] == got[2] < got[3] == got[4]


def test_small_values_and_batches(spark, monkeypatch):
    """A batch's words are stored in pieces, and texts reach Python in small batches: large values crowd an executor's heap."""
    monkeypatch.setattr(m, "PIECE_WORDS", 50)
    rows, target = _rows(), {0, 5, 10}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = m.fit(docs, spark.createDataFrame([(t,) for t in target], "doc_id long"))
    words = [r for r in fitted.batches.where(m.F.col("kind") == m.WORDS).collect()]
    assert len(words) > len({r.batch for r in words}) and all(len(m._unpack(r.n)) <= 50 for r in words)
    got = sorted((r.doc_id, r.n_words, r.difference) for r in m.score(docs, fitted).collect())
    assert got == [(d, n, pytest.approx(x, abs=2e-4)) for d, n, x in sorted(m.brute_force(rows, target))]
    files = [f for f in fitted.batches.inputFiles() if f.startswith(fitted.requests)]
    assert files and all(os.path.exists(f.removeprefix("file://")) for f in files)
    released = m.score(docs, fitted, release=True)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert sorted((r.doc_id, r.n_words, r.difference) for r in released.collect()) == got
    name, size = m.in_small_batches.__globals__["BATCH_BYTES"]
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        assert m.in_small_batches(lambda s: s.conf.get(name))(spark) == size
        spark.conf.set(name, "3m")
        assert m.in_small_batches(lambda s: s.conf.get(name))(spark) == "3m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
