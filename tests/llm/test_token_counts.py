import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from tidemark.llm import token_counts as t

PIECES = t.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer(Unigram([("<unk>", 0.0), *PIECES], unk_id=0, byte_fallback=True))


def _expected(library, text):
    return len(library.encode(t.MARK + text.replace(" ", t.MARK)).ids) if text else 0


def _texts():
    r = random.Random(4)
    alphabet = "aaabcdeeehinorst  \n\té漢🙂.,0123'▁"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(1500)]
    return [*out, "", " ", "   ", "x" * 3000, "the cat  sat   ", "▁", "\x00\x01", "ꙮ" * 50, "of the and " * 800]


def test_equals_the_library(library):
    counter = t.Counter(PIECES)
    assert [counter.count(x) for x in _texts()] == [_expected(library, x) for x in _texts()]


def test_ties():
    pieces = [(t.MARK, 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.5), ("bc", -1.5), ("abc", -2.5), (f"{t.MARK}a", -1.0), *[(f"<0x{k:02X}>", -50.0) for k in range(256)]]
    library = Tokenizer(Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=True))
    counter = t.Counter(pieces)
    r = random.Random(9)
    for _ in range(800):
        text = "".join(r.choice("abcd ") for _ in range(r.randrange(1, 12)))
        assert counter.count(text) == _expected(library, text), text


def test_marks_inside_pieces_are_refused():
    with pytest.raises(ValueError):
        t.Counter([(f"a{t.MARK}b", 0.0)])


def test_rows(spark, library):
    rows = [(1, None), (1, ""), (2, "two words"), (2, "two words"), (None, "é" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", t.F.lit(1))
    got = sorted((str(r.doc_id), r.n_tokens) for r in t.count_tokens(docs, PIECES).collect())
    assert got == sorted((str(d), _expected(library, x or "")) for d, x in rows)
    assert t.count_tokens(docs.limit(0), PIECES).count() == 0
