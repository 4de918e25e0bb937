import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as f


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("next", F.lit("clash")).withColumn("_end", F.lit(1))


def _query(spark, rows, tmp_path):
    _docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return f.op6_fingerprints(spark, str(tmp_path)).collect()


def _edited(rows):
    """By plain loops: n_chars and the edited text's hash of each row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for k, (doc, _) in enumerate(order):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 3
        out.append((str(doc), len(own), hashlib.sha256((own[: len(own) - cut] + following[:cut]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("range_rows", [1, 7, 2000])
def test_edits_equal_brute_force(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(f, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(f, "MAX_BOUNDS", 6)
    r = random.Random(1)
    rows = [(r.randrange(10**6), "".join(r.choice("ab é\n.🙂") for _ in range(r.randrange(80)))) for _ in range(60)]
    rows += [(5, "same"), (5, "same"), (5, "other"), (None, "no id"), (None, None), (7, None), (8, ""), (9, "x" * 30_000), (-3, "negative id")]
    got = _query(spark, rows, tmp_path)
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in got) == _edited(rows)
    assert all(0 <= v <= 1 for x in got for v in (x.near_edited, x.near_next))


def test_one_row_and_no_row(spark, tmp_path):
    only = _query(spark, [(1, "the only one there is")], tmp_path / "a")[0]
    assert only.near_next == 1.0
    assert _query(spark, [], tmp_path / "b") == []


def _print(text):
    """A fingerprint by plain loops."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts, at = [], 0
    for m in re.finditer(r"\n[ \t\r]*\n[ \t\n\x0b\f\r]*", text):
        parts.append(text[at : m.end()])
        at = m.end()
    lines = [[sha(x) for x in s.split("\n")] for part in [*parts, text[at:]] for s in [part]]
    nodes = [sha("section:" + ",".join(x)) for x in lines]
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    pairs = {xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) % (1 << 32) for a, b in zip(["", *w], [*w, ""])} if w else set()
    kept = sorted(pairs)[: f.SKETCH]
    shown = ";".join(f"{n[:12]}({','.join(x[:12] for x in y)})" for n, y in zip(nodes, lines))
    return "|".join([sha("document:" + ",".join(nodes)), shown, ",".join(f"{v:08x}" for v in kept)])


def _like(one, two):
    (a, _, x), (b, _, y) = one.split("|"), two.split("|")
    x, y = (set(filter(None, z.split(","))) for z in (x, y))
    least = sorted(x | y)[: f.SKETCH]
    both = sum(v in x and v in y for v in least)
    return 1.0 if a == b else 2 * both / (len(least) + both) if both else 0.0


def test_fingerprints_and_likeness_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    word = lambda: r.choice(["river", "mill", "été", "🙂", "a", "field", "x" * 40]) + str(r.randrange(30))
    rows = [(k, "".join(word() + r.choice([" ", " ", " ", " ", "\n", "\n\n", " \n \t\r\n\n ", "\t"]) for _ in range(r.randrange(200)))) for k in range(50)]
    rows += [(60, "one"), (61, "one two"), (62, ""), (63, None), (64, "\n\n\n"), (65, " "), (66, "a|b;c(d),e"), (67, "word " * 20_000)]
    got = _query(spark, rows, tmp_path)
    order = sorted(rows, key=lambda x: -x[0])
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        row = next(x for x in got if x.doc_id == doc)
        assert (row.fingerprint, row.edited_fingerprint) == (_print(text), _print(edited))
        assert row.near_edited == pytest.approx(_like(row.fingerprint, row.edited_fingerprint)) and row.near_next == pytest.approx(_like(row.fingerprint, _print(after)))
    told = spark.createDataFrame([(x.fingerprint, x.edited_fingerprint, x.near_edited) for x in got], "a string, b string, near double")
    assert told.where(f.likeness_of(F.col("a"), F.col("b")) != F.col("near")).count() == 0


def test_length_makes_no_leap(spark):
    """One character more changes the likeness by little at any length."""
    texts = [" ".join(f"word{k}" for k in range(200))[:n].rstrip() for n in (12, 25, 31, 32, 64, 127, 128, 150, 1000)]
    rows = spark.createDataFrame([(t, t + "x") for t in texts], "a string, b string")
    got = rows.select("a", f.likeness(f.root(f.tree(F.col("a"))), f.sketch(F.col("a")), f.root(f.tree(F.col("b"))), f.sketch(F.col("b"))).alias("v")).collect()
    assert all(r.v >= 1 - 2.5 / (len(r.a.split()) + 1) - 0.05 for r in got), got


def test_no_two_texts_share_a_root(spark):
    texts = ["a\nb", "a\n\nb", "a\n \nb", "a\n\n\nb", "ab", "a b", "a\x00b", "a\n\n\x00b", "a\n\n\x00\x00b", "", "\n", "\n\n", " ", "a,b", "a", "a\n", "a\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(f.root(f.tree(F.col("t"))).alias("r"))
    assert rows.distinct().count() == len(texts)


def test_differing_branches(spark):
    """By trees, and by fingerprints alone."""
    one, two = "a b c\nd e f\n\nsecond part\n\nthird", "a b c\nd e X\n\nsecond part\n\nthird"
    rows = spark.createDataFrame([(one, two)], "one string, two string")
    assert rows.select(f.differing(f.tree(F.col("one")), f.tree(F.col("two"))).alias("at")).first().at == [0]
    prints = rows.select(*[f.branches(f.fingerprint(f.root(f.tree(F.col(c))), f.tree(F.col(c)), f.sketch(F.col(c)))).alias(c) for c in ("one", "two")])
    row = prints.select(f.differing(F.col("one"), F.col("two")).alias("at"), f.edits(F.col("one"), F.col("two")).alias("places")).first()
    assert row.at == [0] and [tuple(p) for p in row.places] == [(0, 1, None)]


def test_edits_have_places(spark):
    """Edits are found down to the word, removed repeats and moved sections too."""
    long = ". ".join(f"Sentence number {k} says something of its own" for k in range(30))
    cases = [
        ("a b c\nd e f\n\nsecond", "a b c\nd e X\n\nsecond", [0], [(0, 1, 2)]),
        ("same\n\nsame\n\nlast", "same\n\nlast", [1], None),
        ("same\n\nlast", "same\n\nsame\n\nlast", [], []),
        ("one\n\ntwo\n\nthree\n\nfour", "one\n\nthree\n\ntwo\n\nfour", [1, 2], None),
        ("one\n\ntwo", "one\n\ntwo", [], []),
        ("A one\n\nB two\n\n", "B two\n\nA one\n\n", [0, 1], None),
        ("first line\nlast", "first line\nlast\nmore", [0], [(0, None, None)]),
        (long, long, [], []),
        (long, "", [0], None),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "one string, two string").coalesce(1).withColumns({"x": f.tree(F.col("one"), spans=True), "y": f.tree(F.col("two"), spans=True)})
    got = rows.select("one", "two", f.differing(F.col("x"), F.col("y")).alias("at"), f.edits(F.col("x"), F.col("y")).alias("places")).collect()
    found = {(r.one, r.two): (r.at, [tuple(p) for p in r.places]) for r in got}
    for one, two, at, places in cases:
        assert found[one, two][0] == at, (one, two)
        assert sorted({p[0] for p in found[one, two][1]}) == at
        assert places is None or found[one, two][1] == places, (one, two)


def test_edit_of_one_section(spark):
    long = ". ".join(f"Sentence number {k} says something of its own" for k in range(30))
    rows = spark.createDataFrame([(long, long.replace("number 17 says", "number 18 says"))], "one string, two string")
    row = rows.select(f.edits(f.tree(F.col("one"), spans=True), f.tree(F.col("two"), spans=True)).alias("at")).first()
    assert [tuple(p) for p in row.at] == [(0, 0, long.split().index("17"))]
