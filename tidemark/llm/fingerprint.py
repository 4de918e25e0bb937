"""Document fingerprints: a Merkle tree over sections and paragraphs, in built-in
functions only.

Sections end with their blank lines, and paragraphs are a section's lines, so a tree's
leaves make up the whole text. A leaf is the SHA-256 of its line, a section's digest
that of its lines' digests, and the root that of the sections' digests: equal roots
mean equal texts, and where two roots differ, the branches that differ locate the edit
(``differing`` for sections, ``edits`` for sections, paragraphs and words in them).

A fingerprint is ``root|sections|sketch``: each section as ``digest(lines' digests)``,
cut to 12 hexadecimal digits, and a sketch of the text's pairs of neighbouring words
(with marks for its start and end): the SKETCH least of their 32-bit hashes. So
fingerprints alone tell which paragraphs differ (``branches``) and how like two texts
are: 1 for equal roots, and else 2J / (1 + J), J being the share of the SKETCH least
hashes of both sketches that both have. (With SKETCH pairs or fewer that is exact.)
All lengths of text go by these same rules.

A text's own fingerprint is made once, before neighbours meet, and its root and sketch
travel with it. Neighbours in the order of ids come from one shuffle of the texts: ids are cut
into ranges at approximate quantiles, a window finds the next row within a range,
and each range also gets, as a last row, a copy of the next range's first.

Edge cases: a null text counts as empty, and an empty one has one section of one
empty line and no words; a very long text is one row like any other; documents of one
id follow each other by text; null ids come last; repeated rows each give a row; the
only document of a table is its own next one; an empty table gives no rows; only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Hashes of word pairs that a fingerprint keeps.
SKETCH = 64
#: Rows of a range of ids, on average.
RANGE_ROWS = 2000
MAX_BOUNDS = 200
_DIGITS = 12
_SECTION_END = r"\n[\x20\t\r]*\n\s*"
_SPACE = r"[\x20\t\n\x0B\f\r]+"
_CUT = "\x00"


def sections(text: Column) -> Column:
    """Parts of a text, each with the blank lines behind it. (A NUL character parts, too; no two texts have the same parts.)"""
    return F.split(F.regexp_replace(text, F.lit(_SECTION_END), F.lit("$0" + _CUT)), _CUT)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def tree(text: Column, *, spans: bool = False) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest>>>>: a text's sections;
    with spans, each paragraph also has hashes of its words, array<bigint>."""

    def paragraph(p: Column) -> Column:
        own = [F.sha2(p, 256).alias("digest")]
        return F.struct(*own, *[F.transform(words(p), lambda w: F.xxhash64(w)).alias("spans")] * spans)

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), paragraph)

    def node(inside: Column) -> Column:
        return F.struct(F.sha2(F.concat(F.lit("section:"), F.concat_ws(",", _digests(inside))), 256).alias("digest"), inside.alias("paragraphs"))

    return F.transform(F.transform(sections(text), section), node)


def root(tree_: Column) -> Column:
    return F.sha2(F.concat(F.lit("document:"), F.concat_ws(",", _digests(tree_))), 256)


def sketch(text: Column) -> Column:
    """The least 32-bit hashes of the text's pairs of neighbouring words, sorted."""

    def least(found: Column) -> Column:
        before, after = F.concat(F.array(F.lit("")), found), F.concat(found, F.array(F.lit("")))
        pairs = F.zip_with(before, after, lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(1 << 32)))
        return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(pairs)), 1, SKETCH))

    return F.get(F.transform(F.array(words(text)), least), F.lit(0))  # splits the text once


def fingerprint(root_: Column, tree_: Column, sketch_: Column) -> Column:
    def short(node: Column) -> Column:
        return F.substring(node["digest"], 1, _DIGITS)

    listed = F.transform(tree_, lambda s: F.concat(short(s), F.lit("("), F.concat_ws(",", F.transform(s["paragraphs"], short)), F.lit(")")))
    return F.concat_ws("|", root_, F.concat_ws(";", listed), F.concat_ws(",", F.transform(sketch_, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0"))))


def branches(print_: Column) -> Column:
    """The tree that a fingerprint holds, with digests cut short; for ``differing`` and ``edits``."""

    def section(s: Column) -> Column:
        inside = F.split(F.rtrim(F.substring_index(s, "(", -1), F.lit(")")), ",")
        return F.struct(F.substring_index(s, "(", 1).alias("digest"), F.transform(inside, lambda d: F.struct(d.alias("digest"), F.array().cast("array<bigint>").alias("spans"))).alias("paragraphs"))

    return F.transform(F.split(F.get(F.split(print_, r"\|"), F.lit(1)), ";"), section)


def likeness(root_one: Column, sketch_one: Column, root_two: Column, sketch_two: Column) -> Column:
    """Likeness of two fingerprints by their roots and sketches."""
    least = F.slice(F.sort_array(F.array_union(sketch_one, sketch_two)), 1, SKETCH)
    n, both = F.size(least), F.size(F.array_intersect(least, F.array_intersect(sketch_one, sketch_two)))
    return F.when(root_one == root_two, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (n + both))


def likeness_of(one: Column, two: Column) -> Column:
    """Likeness of two fingerprint strings."""

    def parts(c: Column) -> tuple[Column, Column]:
        found = F.split(c, r"\|")
        values = F.filter(F.split(F.get(found, F.lit(2)), ","), lambda v: v != "")
        return F.get(found, F.lit(0)), F.transform(values, lambda v: F.conv(v, 16, 10).cast("long"))

    return likeness(*parts(one), *parts(two))


def _apart(one: Column, two: Column) -> Column:
    """Places (from 0) in the first array, between the start and the end that it shares
    with the second; of arrays of one length, those whose values differ."""
    n, m = F.size(one), F.size(two)
    both = F.least(n, m)
    first = F.array_position(F.zip_with(one, two, lambda a, b: a != b), F.lit(True)).cast("int")
    start = F.when(first > 0, first - 1).otherwise(both)
    last = F.array_position(F.zip_with(F.reverse(one), F.reverse(two), lambda a, b: a != b), F.lit(True)).cast("int")
    end = F.least(F.when(last > 0, last - 1).otherwise(both), both - start)
    return F.filter(F.transform(one, lambda x, k: k), lambda k: (k >= start) & (k < n - end) & ((n != m) | (F.get(one, k) != F.get(two, k))))


def _digests(branches: Column) -> Column:
    return F.transform(branches, lambda b: b["digest"])


def differing(one: Column, two: Column) -> Column:
    """Of two trees (or what ``branches`` reads): numbers (from 0) of the first one's sections that differ from the
    second's by place and count. What only the second has is found the other way round."""
    return _apart(_digests(one), _digests(two))


def edits(one: Column, two: Column) -> Column:
    """array<struct<section, paragraph, span>>: of two trees, the first one's spans that
    (words) that differ, in numbers from 0; span, or paragraph and span, are null where
    the second only has more below, or where the trees hold no spans. Branches are
    compared to those at the same place. Trees need spans, or come from ``branches``."""

    def place(section: Column, paragraph: Column, span: Column) -> Column:
        return F.struct(section.cast("int").alias("section"), paragraph.cast("int").alias("paragraph"), span.cast("int").alias("span"))

    def below(found: Column, otherwise: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(F.array(otherwise))

    def inside(k: Column) -> Column:
        ours = F.get(one, k)["paragraphs"]
        theirs = F.coalesce(F.get(two, k)["paragraphs"], F.slice(ours, 1, 0))

        def spans_of(j: Column) -> Column:
            own = F.get(ours, j)["spans"]
            other = F.coalesce(F.get(theirs, j)["spans"], F.slice(own, 1, 0))
            return below(F.transform(_apart(own, other), lambda i: place(k, j, i)), place(k, j, F.lit(None)))

        return below(F.flatten(F.transform(_apart(_digests(ours), _digests(theirs)), spans_of)), place(k, F.lit(None), F.lit(None)))

    return F.flatten(F.transform(differing(one, two), inside))


def with_next(rows: DataFrame, key: str, carried: str, to: str, made: Callable[[DataFrame], DataFrame] = lambda df: df, also: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Adds ``to``: the carried string of the row that follows by descending key (ties
    by the carried value, null keys last); after the last row comes the first. made: adds
    columns that depend on the carried string only, before rows meet; also: more columns
    to take from the row that follows, and their names."""
    numbers = rows.agg(F.count("*").alias("n"), F.count(key).alias("known")).first()
    parts = max(1, min(MAX_BOUNDS * MAX_BOUNDS, numbers["n"] // RANGE_ROWS))
    coarse_n = min(parts, MAX_BOUNDS)
    fine_n = -(-parts // coarse_n)
    bounds: list = []
    if parts > 1 and numbers["known"]:
        shares = [k / (coarse_n * fine_n) for k in range(1, coarse_n * fine_n)]
        bounds = sorted({x for x in rows.agg(F.percentile_approx(key, shares, 20 * coarse_n * fine_n).alias("q")).first()["q"] if x is not None})
    # a range's number grows as the key falls; found in two steps, so that no row is compared to all bounds
    chunks = [bounds[k : k + MAX_BOUNDS] for k in range(0, len(bounds), MAX_BOUNDS)]
    above = F.lit(0)
    if chunks:
        tops = F.array(*[F.lit(c[-1]) for c in chunks])
        coarse = F.size(F.filter(tops, lambda b: b < F.col(key)))
        fine = F.array(*[F.array(*map(F.lit, c)) for c in chunks])
        own = F.coalesce(F.get(fine, coarse), F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>"))
        above = coarse * MAX_BOUNDS + F.size(F.filter(own, lambda b: b < F.col(key)))
    ranged = rows.withColumn("_range", F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - above).cast("long"))
    order = [F.desc_nulls_last(key), F.col(carried)]
    # each range's first row; aggregated before it is shuffled
    greatest = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    firsts = (
        ranged.select("_range", key, carried).join(F.broadcast(greatest), "_range").where(F.col(key).eqNullSafe(F.col("_top")))
        .groupBy("_range").agg(F.min(carried).alias(carried), F.max(key).alias(key))
    )
    numbered = greatest.select("_range", F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    ends = firsts.join(F.broadcast(numbered), "_range").select(F.col("_before").alias("_range"), F.col(carried), F.lit(True).alias("_end"))
    everything = made(ranged.withColumn("_end", F.lit(False))).unionByName(made(ends), allowMissingColumns=True)
    window = Window.partitionBy("_range").orderBy(F.col("_end"), *order)
    return everything.withColumns({name: F.lead(c).over(window) for c, name in {carried: to, **also}.items()}).where(~F.col("_end")).drop("_end", "_range")


def _printed(rows: DataFrame, text: str) -> DataFrame:
    """Adds root_, sketch_ and print_ of a column of texts."""
    rows = rows.withColumns({"_tree": tree(F.col(text)), f"sketch_{text}": sketch(F.col(text))}).withColumn(f"root_{text}", root(F.col("_tree")))
    return rows.withColumn(f"print_{text}", fingerprint(F.col(f"root_{text}"), F.col("_tree"), F.col(f"sketch_{text}"))).drop("_tree")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(documents, "doc_id", "text", "next", lambda df: _printed(df, "text"), {"root_text": "root_next", "sketch_text": "sketch_next"})
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next, cast(floor(length(text) / 3) as int))")))
    rows = _printed(rows, "edited")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("print_text").alias("fingerprint"), F.col("print_edited").alias("edited_fingerprint"),
        *[likeness(F.col("root_text"), F.col("sketch_text"), F.col(f"root_{t}"), F.col(f"sketch_{t}")).alias(f"near_{t}") for t in ("edited", "next")],
    )
