"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that occurs in a unit
of text; dynamic programming over its positions carries the best score and the
number of pieces, and no pieces are built. Ties and unknown characters go by the
rules of the ``tokenizers`` library's Unigram model with byte fallback: a later
candidate must be strictly better, candidates for a position come in the order of
their starts, an unknown character scores 10 below the vocabulary's least, counts
one piece for each of its bytes, and is a candidate only where no piece is that
single character.

Spaces become U+2581 and a text gets one in front, as in sentencepiece. No piece of
the vocabulary has that mark behind another character (checked), so texts are cut
in front of the marks, each unit is solved on its own, and the counts add up.
Units repeat, so their counts are cached.

Edge cases: null and empty texts have 0 tokens; runs of spaces, line breaks and
texts without any space are ordinary text; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import named, once, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Cached units of one Python worker; a full cache starts anew.
CACHE_ENTRIES = 200_000
LONG_UNIT = 64


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, but its control and unknown pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(k), sp.get_score(k)) for k in range(sp.get_piece_size()) if not sp.is_control(k) and not sp.is_unknown(k)]


class Counter(dict):
    """Number of pieces by word (a unit without its mark); a missing word is solved here."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"the piece {piece!r} has a mark inside, so texts can't be cut at marks")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def best(self, unit: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n, unknown = len(unit), self.unknown
        scores: list[float | None] = [0.0] + [None] * n
        counts, single = [0] * (n + 1), bytearray(n + 1)
        at = 1  # positions before this one are final

        def settle(to: int) -> None:
            nonlocal at
            while at < to:
                if not single[at]:
                    score = scores[at - 1] + unknown
                    if scores[at] is None or score > scores[at]:
                        scores[at], counts[at] = score, counts[at - 1] + len(unit[at - 1].encode("utf-8", "surrogatepass"))
                at += 1

        for end, (length, value) in self.automaton.iter(unit):  # by end, the longest first
            end += 1
            if at < end:
                settle(end)
            if length == 1:
                single[end] = 1
            score = scores[end - length] + value
            if scores[end] is None or score > scores[end]:
                scores[end], counts[end] = score, counts[end - length] + 1
        settle(n + 1)
        return scores[n], counts[n]

    def __missing__(self, word: str) -> int:
        count = self.best(MARK + word)[1]
        if len(word) <= LONG_UNIT:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = (text.replace(MARK, " ") if MARK in text else text).split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total, marks = 0, 0  # a run of spaces is one unit with the word behind it
        for word in words:
            marks += 1
            if word:
                total += self[word] if marks == 1 else self.best(MARK * marks + word)[1]
                marks = 0
        return total + (self.best(MARK * marks)[1] if marks else 0)


def count_tokens(documents: DataFrame, pieces: list[tuple[str, float]], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "n_tokens") -> DataFrame:
    """The kept columns of every row and the token count of its whole text. The
    vocabulary (a tokenizer's, not the data's) travels by broadcast."""
    held = documents.sparkSession.sparkContext.broadcast(pieces)
    rows = documents.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [f"k{i}" for i in range(len(keep))] + ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(held.value, Counter)
        for batch in batches:
            for part, _, _ in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([counter.count(x) for x in part.column("text").to_pylist()], pa.int64())], names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["value long"])
    return rows.mapInArrow(run, schema).toDF(*keep, to)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
