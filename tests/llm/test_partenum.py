import random
import re

import numpy as np
import pytest

from tidemark.llm import partenum as p


def _texts(seed, n=160):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(30)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A  b\nc d"), (8, "x " * 300), (9, "X " * 200), (10, "é " * 5 + " b")]
    while len(out) < n:
        base = [word() for _ in range(r.choice([5, 6, 7, 8, 12, 20, 40, 90, 200]))]
        if r.random() < 0.4:
            base = passage + base[: r.choice([3, 8, 12, 30])]
        for _ in range(r.choice([1, 1, 1, 2, 4, 9, 14])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[: -r.choice([1, 2, 5])] or copy
            out.append((len(out) + 1, " ".join(copy)))
    r.shuffle(out)
    return out


def _found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_id", p.F.lit("clash")).withColumn("n_shingles", p.F.lit(0)).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in p.linked(docs).collect()}


def test_similar_sets_share_a_signature():
    """The guarantee itself, at the edge: sets that differ as much as they may."""
    rng, bands = np.random.default_rng(3), p.Bands(75)
    for size in [3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 20, 27, 28, 37, 50, 75, 100, 133, 200, 267, 600, 1500]:
        for _ in range(12):
            other = int(rng.integers(-(-3 * size // 4), 4 * size // 3 + 1))
            common = -(-3 * (size + other) // 7)
            if common > min(size, other):
                continue
            pool = rng.integers(0, 1 << 63, size + other, dtype=np.uint64)
            x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size : size + other - common]]))
            if len(x) == len(y) == common:
                continue
            (sx, mx), (sy, my) = p.signatures(x, bands), p.signatures(y, bands)
            both = [(mx[sx == z][0], my[sy == z][0]) for z in np.intersect1d(sx, sy)]
            counted = [min(m >> 1, k >> 1) for m, k in both if not m & k & 1]
            assert counted and len(counted) >= min(counted), (size, other)
            assert np.intersect1d(*(p.signatures(z, bands)[0] for z in (x, y))).size >= 1, (size, other)


@pytest.mark.parametrize("seed,group", [(1, 8), (3, 2), (4, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(p, "GROUP", group)
    monkeypatch.setattr(p, "WITHDRAWN", 0 if seed == 3 else 1000)
    rows = _texts(seed)
    assert _found(spark, rows) == p.brute_force(rows)


def test_crowded_shingles_of_the_last_stage(spark, monkeypatch):
    """Near copies that the stages before leave in components of their own meet by a few pairs, not by all of them."""
    monkeypatch.setattr(p, "WITHDRAWN", 0)
    monkeypatch.setattr(p._Join, "sign", lambda self, texts, withdrawn=None: self.stored(self.info.selectExpr("set_id AS id", "1L AS sig")))
    met, across = [], p._across
    monkeypatch.setattr(p, "_across", lambda *given: met.append(across(*given)) or met[-1].persist())
    r = random.Random(11)
    passage = [f"w{k}" for k in range(124)]
    rows = []
    for k in range(240):
        copy = list(passage)
        for at in r.sample(range(5, 119), 1 if k % 3 == 0 else 2):
            copy[at] = f"x{r.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    assert _found(spark, rows) == p.brute_force(rows)
    assert len(met) == 1 and met[0].count() < len(rows)


def test_repeated_rows_null_ids_and_one_of_each(spark):
    long = " ".join(f"v{i}" for i in range(40))
    rows = [(None, long), (7, long), (7, long), (9, long + " tail"), (11, "alone in here it is"), (None, "nothing like it at all"), (12, None), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(f"{r.doc_id} {r.component_id}" for r in p.linked(docs).collect())
    assert got == sorted(["None 7", "7 7", "7 7", "9 7", "11 11", "None None", "12 12", "13 13"])
    kept = sorted(str(r.doc_id) for r in p.one_of_each(docs).collect())
    assert kept == sorted(["None", "7", "11", "12", "13"])


def test_one_of_each_decides_by_row(spark):
    """Rows that share a doc_id but not a component all stay; of copies without an id one stays."""
    long, other = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, long), (1, other), (1, other + " tail"), (2, other), (None, "lone text " * 9), (None, "lone text " * 9), (None, ""), (None, None), (3, " "), (3, " "), (4, "w " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_n", "_text_id", "_number", "set_id", "root", "text_id", "n"):
        docs = docs.withColumn(c, p.F.lit(c))
    got = p.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(f"{r.doc_id} {(r.text or '')[:9]}" for r in got.collect()) == sorted(["1 v0 v1 v2 ", "1 u0 u1 u2 ", "None lone text", "None ", "None ", "3  ", "4 w w w w w"])
    assert all(r[c] == c for r in got.collect() for c in ("_n", "_text_id", "root"))
    assert p.one_of_each(docs.limit(0)).count() == 0


def test_sketches_never_part_more_than_sets_differ():
    rng = np.random.default_rng(7)
    for size in (1, 5, 31, 33, 64, 200, 1000):
        other = int(rng.integers(-(-3 * size // 4), 4 * size // 3 + 1))
        pool = rng.integers(0, 1 << 63, size + other, dtype=np.uint64)
        common = int(rng.integers(0, min(size, other) + 1))
        x, y = pool[:size], np.concatenate([pool[:common], pool[size : size + other - common]])
        a, b = sorted((p.sketch(x), p.sketch(y)), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= size + other - 2 * common


def test_groups_cut_by_batches(monkeypatch):
    """The streaming pass gives the same whatever the batch size."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = np.unique(np.stack([np.sort(rng.integers(0, 40, 300)), rng.integers(0, 60, 300)], 1), axis=0)
    mark = pa.array(np.full(len(rows), 2), pa.int16())

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size, 0]), pa.array(rows[k : k + size, 1]), mark[k : k + size]], ["sig", "id", "mark"]) for k in range(0, len(rows), size)]
        out = [r for b in p._grouped(iter(batches), 4) for r in zip(*(c.to_pylist() for c in b.columns))]
        pairs = {}
        for a, b, n, _, hot in out:
            if hot is None:
                pairs[a, b] = pairs.get((a, b), 0) + n
        return pairs, sorted((r[4], r[0]) for r in out if r[4] is not None)

    whole = run(10_000)
    assert whole[1] and all(run(k) == whole for k in (1, 2, 3, 7, 50))


def test_empty_table(spark):
    assert p.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_a_star_and_repeated_links(spark):
    from tidemark.llm.components import components

    r = random.Random(5)
    path = [(k, k + 1) for k in range(0, 40)]
    r.shuffle(path)
    star = [(100, k) for k in range(101, 160)] + [(k, 199) for k in range(160, 180)]
    links = path + star + star[:9] + [(b, a) for a, b in path[:5]] + [(300, 300), (400, 401), (400, 401)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_links_have_no_exchange(spark):
    """A round of components of few links is one task; of many it's dealt, with the same result."""
    from tidemark.llm import components as c

    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 50), (100, 50), (100, 60)], "a long, b long")
    plan = c._small_star(c._large_star(links.coalesce(1), True), True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("(?<!Broadcast)Exchange", plan)
    found = {}
    for limit in (0, 100):
        at, c.SMALL_EDGES = c.SMALL_EDGES, limit
        try:
            found[limit] = sorted(map(tuple, c.components(links).collect()))
        finally:
            c.SMALL_EDGES = at
    assert found[0] == found[100] == [(k, 0) for k in range(1, 31)] + [(60, 50), (100, 50)]
