import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    r = random.Random(1)
    alphabet = "abrevlstdm'' '  \n\t é1²٣!#ßñ　🙂'\x00"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    return [*out, "", "'s", "'re", "a'", "a'r", "don't 'll 'LL", "x" * 5000, "ab" * 3000, " " * 4000 + "x", "\n" * 777, " \n a", "<|endoftext|>"]


def test_equals_the_library(library):
    own, texts = bpe.codec(FILE), _texts()
    for text, (ids, written, decoded, starts) in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode_ordinary(text)
        assert ids.tolist() == want and written == " ".join(map(str, want)) and decoded == text.encode()
        assert (len(starts) > 0) == bool(text) and (not text or starts[0] == 0)


def test_every_character_class(library):
    own = bpe.codec(FILE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 17]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} !{chr(c)}!" for c in points]
    assert all(ids.tolist() == library.encode_ordinary(t) for t, (ids, *_) in zip(texts, own.encode_all(texts)))


def test_scan_equals_the_walk():
    numbers, compose, _ = bpe._monoid()
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 1000, 5000):
        f = numbers[rng.integers(0, 14, n)]
        assert (bpe._scan(f, compose) == bpe._walk(f, compose)).all()


def test_rows_and_decoding(spark, library):
    rows = [(1, None), (1, ""), (2, "it's two"), (2, "it's two"), (None, "é" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", bpe.F.lit("clash"))
    digest = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(docs, FILE).collect())
    ids = [(d, library.encode_ordinary(x or ""), x or "") for d, x in rows]
    assert digest == sorted((str(d), len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for d, i, x in ids)
    back = bpe.decode(bpe.encode(docs, FILE), FILE).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(x for _, _, x in ids)
    assert bpe.encode(docs.limit(0), FILE).count() == 0
