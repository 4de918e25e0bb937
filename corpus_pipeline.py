"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and reads it again for the next one. All stages but
the last return the columns of documents.

Edge cases: null and empty texts are scored, kept or dropped by the models' bias, link
with nothing, are not contaminated and have no tokens; very long texts are worked on
whole; of rows that repeat, one stays from the third stage on; ties go by doc_id, then
by the text's hash; of an empty table no rows come; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, partenum, quality, toxicity
from tidemark.llm.common import BATCH_BYTES, drop_folder, in_small_batches, named, scratch, stored, table, unused  # noqa: F401 (BATCH_BYTES is read from here, too)

TOXIC, GOOD = 0.5, 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@in_small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), to=score)
    return scored.where(F.col(score) < TOXIC).select(*named(docs.columns))


@in_small_batches
def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than GOOD go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("score", docs.columns)
    scored = quality.score(docs, model, keep=tuple(docs.columns), to=score)
    return scored.where(F.col(score) >= GOOD).select(*named(docs.columns))


@in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return partenum.one_of_each(docs)


@in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark holds a twentieth of the words or more go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with the digests of ids and decoded texts."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("ngram_join", one_of_each),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: Learned scores have no SQL; tests compare each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = scratch(spark)
        docs = stored(stage(spark, docs, sf_dir), at)
        if old:
            drop_folder(spark, old)
        old = at
    return docs
