import pytest
from pyspark.sql import Row

from tidemark.llm import decontaminate as d

LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [("a", LONG), ("b", "Short Item!"), ("b", "Short Item!"), ("c", None), ("d", ""), ("e", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (None, "x y")]
DOCS = [
    (1, "before " + LONG.upper() + " after " + "z " * 50), (2, "a short, item"), (2, "a short, item"), (3, None), (4, ""), (None, "SHORT item"),
    (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (6, "é" * 4000 + " short\nitem short"), (7, "y " * 400 + "short item"), (8, "w1 w2-w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 tail " * 2),
]


def _found(spark, **options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", d.F.lit("clash")).withColumn("n_hit", d.F.lit(1))
    return d.scan(docs, spark.createDataFrame(ITEMS, "item_id string, text string"), **options)


def _key(r):
    return str(r)


def test_equals_brute_force(spark):
    want = sorted(d.brute_force(DOCS, ITEMS), key=_key)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in _found(spark).collect()], key=_key) == want


def test_benchmark_in_several_passes(spark):
    want = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in _found(spark).collect()], key=_key)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in _found(spark, broadcast_bytes=100).collect()], key=_key) == want


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert {r.doc_id for r in d.without_contaminated(docs, items).collect()} == {3, 4, 5, 6, 7} - {6}
    cut = {r.doc_id: r.text for r in d.without_spans(docs, items).collect()}
    assert cut[2] == "a , " and cut[7] == "y " * 400 + " " and cut[3] in (None, "")


def test_clashing_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for c in ("n_hit", "N_WORDS", "items", "spans", "k0", "k1", "k2", "row", "words_hit", "a.b", "value"):
        docs = docs.withColumn(c, d.F.lit(c))
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for limit in (1 << 30, 100):
        kept = d.without_contaminated(docs, items, broadcast_bytes=limit)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 7}
        assert all(r["k1"] == "k1" and r["a.b"] == "a.b" and r["n_hit"] == "n_hit" for r in kept.collect())
    assert d.without_spans(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert d.scan(docs, items).count() == 0
    assert d.scan(spark.createDataFrame(DOCS, "doc_id long, text string"), items).select("n_hit").distinct().collect() == [Row(n_hit=0)]


@pytest.mark.parametrize("limit", [1 << 30, 64])
def test_items_without_an_id_are_hit(spark, limit):
    """They count for the words hit but aren't listed."""
    passage = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"before {passage} behind"), (2, "nothing of it"), (3, "named item here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), ("a", "named item")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, list(r.items)) for r in d.scan(docs, benchmark, broadcast_bytes=limit).collect()}
    assert got == {1: (20, []), 2: (0, []), 3: (2, ["a"])}
