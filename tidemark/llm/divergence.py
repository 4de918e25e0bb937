"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are runs of letters (bytes above 127 included), only A-Z lower-cased. A language
keeps the terms that at least ``min_docs`` of its documents hold, V of them. With count
occurrences of a kept term and N of all of them, a group (language, source) gives the term
p = 1 + floor(10^9 * (count + 5) / (N + 5 V)); so does the language itself, giving q.

The distance of two sources is the sum of abs(p - p') over all V terms. It is found by
inclusion and exclusion over the terms that each of them holds, never by a table of
sources times terms:

- a source's terms, as if the other had none of them, are priced from the histogram of its
  counts: running sums over its different values of p, cut where p passes the other's p of
  an absent term;
- the terms that both hold are corrected by a join of postings (a term's sources, each pair
  once), summed before they are shuffled;
- terms that neither holds cost a constant each.

Words are counted in Arrow batches: a batch's counts are summed before they leave the
task. All arithmetic is in whole numbers (decimals where 64 bits could overflow).

Edge cases: null text, lang and source are ''; every row counts as a document, repeated
ones and those without an id too; a group without words takes part with counts of 0;
a language without kept terms has distances of 0; equal values go by the item's UTF-8
bytes; very long texts are worked on whole, a text's words in one task's memory; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

MIN_DOCS, TOP = 30, 50
#: Entries (group, term) that a task holds before it hands them on.
HELD = 200_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows to (lang, source, term, n, docs), summed as far as a task's memory allows."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            keys = pa.array(found, pa.binary()).cast(pa.string())
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), keys, pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            into = held.setdefault((lang, source), {})
            before = len(into)
            for term, n in Counter(terms(text)).items():
                if (entry := into.get(term)) is None:
                    into[term] = [n, 1]
                else:
                    entry[0] += n
                    entry[1] += 1
            size += len(into) - before
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def _price(count: Column, total: Column, kept: Column) -> Column:
    """p of a count: exact whole numbers, whatever their size."""
    over, under = (count.cast("decimal(20,0)") + 5) * F.lit(10**9).cast("decimal(10,0)"), total.cast("decimal(20,0)") + kept.cast("decimal(17,0)") * F.lit(5).cast("decimal(1,0)")
    return F.call_function("div", over, under) + 1


def postings(documents: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of kept terms, and (lang, source, total, held, kept, absent) of
    every group: its occurrences of kept terms, how many of them it holds, how many the
    language keeps, and p of one that it doesn't hold (null if none is kept)."""
    docs = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    raw = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    held = stored(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    sizes = held.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "held", "kept"])
    absent = F.when(F.col("kept") > 0, _price(F.lit(0), F.col("total"), F.col("kept")))
    return held, stored(groups.withColumn("absent", absent))


def _one_sided(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, alone): what a source's terms cost if the other holds none of them."""
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("h"))
    asked = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("p")), "lang").where("source != other")
    rows = histogram.select("lang", "source", "p", "h", F.lit(None).cast("string").alias("other")).unionByName(asked.select("lang", "source", "p", F.lit(0).cast("long").alias("h"), "other"))
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({
        "n": F.sum("h").over(below), "s": F.sum(F.col("h") * F.col("p")).over(below), "all_n": F.sum("h").over(group), "all_s": F.sum(F.col("h") * F.col("p")).over(group),
    }).where("other is not null")
    alone = F.col("all_s") - 2 * F.col("s") - F.col("p") * (F.col("all_n") - 2 * F.col("n"))
    return sums.select("lang", "source", "other", F.coalesce(alone, F.lit(0)).alias("alone"))


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each source's distance
    to every other one of its language, ``term`` its ``top`` terms with the largest p - q."""
    held, groups = postings(documents, min_docs)
    own = held.join(groups.select("lang", "source", "total", "kept", "absent"), ["lang", "source"])
    priced = stored(own.select("lang", "source", "term", "n", _price(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "absent"))

    alone = _one_sided(priced.select("lang", "source", "p"), groups)
    one, two = ([F.col("lang"), F.col("term"), *[F.col(c).alias(f"{c}_{k}") for c in ("source", "p", "absent")]] for k in (1, 2))
    both = priced.select(*one).join(priced.select(*two), ["lang", "term"]).where("source_1 < source_2")
    excess = F.abs(F.col("p_1") - F.col("p_2")) - F.abs(F.col("p_1") - F.col("absent_2")) - F.abs(F.col("p_2") - F.col("absent_1"))
    shared = stored(both.groupBy("lang", "source_1", "source_2").agg(F.sum(excess).alias("excess"), F.count("*").alias("shared")))
    turned = shared.select("lang", F.col("source_1").alias("source"), F.col("source_2").alias("other"), "excess", "shared")
    turned = turned.unionByName(shared.select("lang", F.col("source_2").alias("source"), F.col("source_1").alias("other"), "excess", "shared"))
    theirs = groups.select("lang", F.col("source").alias("other"), F.col("held").alias("other_held"), F.col("absent").alias("other_absent"))
    back = alone.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("alone").alias("back"))
    pairs = alone.join(back, ["lang", "source", "other"]).join(turned, ["lang", "source", "other"], "left").na.fill(0, ["excess", "shared"])
    pairs = pairs.join(groups.select("lang", "source", "held", "kept", "absent"), ["lang", "source"]).join(theirs, ["lang", "other"])
    neither = (F.col("kept") - F.col("held") - F.col("other_held") + F.col("shared")) * F.coalesce(F.abs(F.col("absent") - F.col("other_absent")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("alone") + F.col("back") + F.col("excess") + neither).alias("value"))

    of_lang = held.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.max("kept").alias("kept"))
    q = of_lang.join(langs, "lang").select("lang", "term", _price(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))
    over = priced.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    listed = over.withColumn("rank", place).where(F.col("rank") <= top)
    out = pairs.withColumn("rank", place).unionByName(listed)
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
