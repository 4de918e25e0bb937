import random
import re
from collections import Counter

from tidemark.llm import divergence as dv


def _brute(docs, min_docs, top):
    words = [(lang or "", source or "", [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in docs]
    out = []
    for lang in {w[0] for w in words}:
        seen = Counter(t for x in words if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = {}
        for x in words:
            if x[0] == lang:
                counts.setdefault(x[1], Counter()).update(t for t in x[2] if t in kept)
        whole = sum(counts.values(), Counter())
        price = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(sum(abs(price(c, t) - price(d, t)) for t in kept), r) for r, d in counts.items() if r != s]
            over = [(price(c, t) - price(whole, t), t) for t in kept if c[t] > 0 and price(c, t) > price(whole, t)]
            for part, found, n in (("pair", pairs, None), ("term", over, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n])]
    return sorted(out)


def _got(spark, docs, min_docs, top, **extra):
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    return sorted(tuple(r) for r in dv.divergence(df, min_docs, top).collect())


def test_equals_brute_force(spark, monkeypatch):
    pick = random.Random(3)
    vocabulary = ["the", "The", "été", "ÉTÉ", "a1b", "naïve", "x", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    docs = [(pick.choice(["en", "de", None]), pick.choice(["a", "b", "c", "ß", None]), " ".join(pick.choice(vocabulary[: pick.randint(2, len(vocabulary))]) for _ in range(pick.randint(0, 80)))) for _ in range(160)]
    docs += [("en", "only", None), ("en", "only", "12 34"), ("fr", "rare", "seule"), ("fr", "other", "autre")] + docs[:9]
    for held in (7, 200_000):  # entries that a task hands on now and then, or at its end
        monkeypatch.setattr(dv, "HELD", held)
        assert _got(spark, docs, 5, 4) == _brute(docs, 5, 4)


def test_hot_source_long_text_and_ties(spark):
    docs = [("en", "hot", "alpha beta gamma " * 20)] * 40 + [("en", f"s{k}", "alpha beta") for k in range(6)] + [("en", "long", "delta alpha " * 60_000)]
    assert _got(spark, docs, 2, 3) == _brute(docs, 2, 3)


def test_empty_and_whole_numbers(spark):
    assert _got(spark, [], 1, 3) == []
    from pyspark.sql import functions as F

    n = 4 * 10**18
    row = spark.range(1).select(dv._price(F.lit(n), F.lit(n) + 7, F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (n + 7 + 55)


def test_terms():
    assert dv.terms("Été ÉTÉ it's A1b\tx_y") == [x.encode() for x in ("Été", "ÉtÉ", "it", "s", "a", "b", "x", "y")]


def test_query_takes_clashing_columns(spark, tmp_path):
    docs = [("en", f"s{k % 3}", "alpha beta", "p", 1, "r") for k in range(90)]
    spark.createDataFrame(docs, "lang string, source string, text string, term string, n int, part string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dv.op12_source_divergence(spark, f"file://{tmp_path}").collect()
    assert {r.part for r in got} == {"pair"} and len(got) == 6 and all(r.value == 0 for r in got)
