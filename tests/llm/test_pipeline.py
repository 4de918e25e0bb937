import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_each_stage_equals_a_brute_force_version_on_what_it_gets(spark):
    import public_tokenizers

    import corpus_pipeline as c
    from tidemark.llm import bpe, decontaminate, partenum, quality, toxicity
    from tidemark.llm.common import stored, table

    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    labels = table(spark, SF, "labels")
    for k, (name, stage) in enumerate(c.STAGES):
        given = [(r.doc_id, r.text) for r in docs.collect()]
        out = stored(stage(spark, docs, SF))
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name in ("toxicity", "quality"):
            module, ok = (toxicity, lambda s: s < 0.5) if name == "toxicity" else (quality, lambda s: s >= 0.3)
            want = {r.doc_id for r in module.score(docs, module.fit(docs, labels)).collect() if ok(r.score)}
        elif name == "ngram_join":
            want = {root for _, root in partenum.brute_force(given).values()}
        elif name == "decontamination":
            want = {d for d, n, hit, _ in decontaminate.brute_force(given, items) if not (hit and 20 * hit >= n)}
        else:
            want = {d for d, _ in given}
            own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            texts = dict(given)
            for r in out.collect():
                assert own.decode(r.token_ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.token_ids)
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert kept == want, name
        assert k == len(c.STAGES) - 1 or out.columns == columns
        docs = out
    final = c.run(spark, SF)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_take_nulls_repeats_long_texts_clashing_columns_and_empty_tables(spark):
    """Scores by the models' own numbers, added up word by word here; what a stage keeps follows from them."""
    import numpy as np
    from pyspark.sql import functions as F

    import corpus_pipeline as c
    from tidemark.llm import quality, toxicity
    from tidemark.llm.common import table

    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "long words " * 30_000), (900_004, "odd one"), (900_004, "odd one"), (None, "no id here at all")], "doc_id long, text string")
    mixed = docs.unionByName(extra, allowMissingColumns=True)
    for name in ("_score", "score", "value", "k0", "k1", "n_hit", "n_words", "items", "_n", "_text_id", "set_id"):
        mixed = mixed.withColumn(name, F.lit(name))
    labels = table(spark, SF, "labels")
    for name, stage in c.STAGES[:4]:
        out = stage(spark, mixed, SF)
        assert out.columns == mixed.columns
        rows = out.collect()
        assert all(r["k1"] == "k1" and r["score"] == "score" and r["_n"] == "_n" for r in rows)
        texts = {r.doc_id: r.text for r in mixed.collect() if r.doc_id is not None}
        kept = {r.doc_id for r in rows if r.doc_id is not None}
        if name == "toxicity":
            m = toxicity.fit(mixed, labels)
            want = {d for d, t in texts.items() if _toxic(m, t or "") < 0.5}
        elif name == "quality":
            m = quality.fit(mixed, labels)
            want = set()
            for d, t in texts.items():
                buckets, _ = quality.features([t or ""])
                mean = sum(float(m.values[b]) for b in buckets) / max(1, len(buckets))
                want |= {d} if 1 / (1 + np.exp(-(m.bias + mean))) >= 0.3 else set()
        elif name == "ngram_join":
            assert sum(r.doc_id == 900_004 for r in rows) == 1
            continue
        else:
            continue
        assert kept == want, name
        assert stage(spark, mixed.limit(0), SF).count() == 0


def _toxic(m, text):
    """The document's score from its sentences, one after the other."""
    import re

    import numpy as np

    from tidemark.llm import toxicity as x

    lower = re.sub("[A-Z]", lambda z: z[0].lower(), text)
    evidence, n = [], 0
    for sentence in re.split(r"[.!?\n\r;|]", lower):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
        n += len(words)
        found = set()
        for w in words:
            found.add(x.bucket(w))
            raw = w.encode()
            for k in x.BEGINNINGS:
                if len(raw) > k:
                    h = x.tv.word_hashes(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), np.array([k]))[0] + np.uint64(k)
                    found.add(int(h % np.uint64(x.BUCKETS)))
        if words:
            evidence.append(sum(float(m.weights[b]) for b in found))
    worst, density = max(evidence, default=0.0), sum(evidence) / (1 + n / x.LENGTH)
    return 1 / (1 + np.exp(-(m.bias + m.of_worst * worst + m.of_density * density)))


def test_stages_hand_texts_to_python_in_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline as c

    key, bound = c.BATCH_BYTES
    before = spark.conf.get(key, None)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text")

    def measured(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)

    try:
        for given, most in ((None, 3 << 20), ("1m", 3 << 19)):
            spark.conf.set(key, given) if given else spark.conf.unset(key)
            for _, stage in c.STAGES[:1]:
                stage(spark, docs.limit(0), SF)
            sizes = [r.n for r in docs.mapInArrow(measured, "n long").collect()]
            assert sum(sizes) > 8 << 20 and max(sizes) < most
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
