import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.common import held_out, labelled_sample, table

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@here
@pytest.mark.parametrize("query,label,least", [(quality.op1_quality, "quality", 0.97), (toxicity.op2_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, SF)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == table(spark, SF, "documents").count()
    known = scored.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(known) > 50 and np.mean([r.predicted == r[label] for r in known]) >= least
    assert all(0 <= r.score <= 1 for r in known)


@pytest.fixture(scope="module")
def tables(spark):
    good, bad = "The quiet river ran past the old mill and the fields beyond.", "!!! BUY$$$ NOW$$$ CLICK!!! "
    texts = [(k, good if k % 2 else bad, k % 2) for k in range(200)]
    docs = spark.createDataFrame([(k, f"{t} w{k}") for k, t, _ in texts] + [(900, None), (901, ""), (902, " \n"), (903, "word " * 30_000), (904, "é" * 50_000), (None, good), (5, f"{good} w5")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 1 - q) for k, _, q in texts] + [(900, None, None), (None, 1, 0), (7, 0, 1), (8, 2, 2), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.withColumn("value", F.lit("clash")).withColumn("label", F.lit("x")), labels


@pytest.mark.parametrize("module,high", [(quality, 1), (toxicity, 0)])
def test_edge_cases(spark, tables, module, high):
    docs, labels = tables
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert by[900] == by[901] == by[902]
    sides = [np.mean([s for k in by if k is not None and k < 200 and k % 2 == side for s in by[k]]) for side in (0, 1)]
    assert sides[high] > 0.7 and sides[1 - high] < 0.3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_documents(spark, tables, module):
    docs, labels = tables
    model = module.fit(docs, labels.limit(0))
    assert {r.score for r in module.score(docs.where("doc_id = 5"), model).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_learns_only_from_what_is_not_held_out(spark, tables):
    docs, labels = tables
    sample = labelled_sample(docs, labels, "quality", 50).select("doc_id").distinct()
    assert 0 < sample.count() <= 50 and sample.where(held_out(F.col("doc_id"))).count() == 0
    assert sample.where("doc_id in (7, 900)").count() == 0


def test_group_mentions_are_neutral(spark):
    """Groups that only toxic sentences mention in the labelled rows weigh nothing by themselves."""
    rows = [(k, "The muslim neighbour is a worthless idiot." if k % 2 else "The kind neighbour waters the garden.", k % 2) for k in range(200)]
    docs = spark.createDataFrame([(k, f"{t} Day {k}.") for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    weigh = lambda w: float(model.weights[toxicity.bucket(w)])
    assert weigh("muslim") < 0.5 * weigh("idiot")
    asked = spark.createDataFrame([(1, "The muslim neighbour waters the garden."), (2, "The christian neighbour waters the garden."), (3, "The neighbour is a worthless idiot.")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[3] > 0.5 and got[1] < 0.5 and got[2] < 0.5


@pytest.mark.parametrize("term,other", [("muslims", "christians"), ("immigrants", "refugees"), ("transgender", "disabled"), ("flüchtlinge", "einwanderer")])
def test_beginnings_of_group_terms_are_neutral(spark, term, other):
    """Long terms that only toxic sentences mention weigh as little by their beginnings as by the word."""
    rows = [(k, f"Those {term} are worthless idiots." if k % 2 else "The kind neighbour waters the garden.", k % 2) for k in range(200)]
    docs = spark.createDataFrame([(k, f"{t} Day {k}.") for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    evidence = lambda w: float(model.weights[toxicity.term_buckets(w)].sum())
    assert evidence(term) < 0.25 * evidence("idiots")
    asked = [f"The {term} next door water the garden. " * 3, f"The {other} next door water the garden. " * 3, f"Many {term} came, and {term} stayed. {term} cook, {term} read.", "They are worthless idiots."]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert max(got[0], got[1], got[2]) < 0.5 < got[3]
    assert abs(got[0] - got[1]) < 0.1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_without_documents_take_no_places(spark, module):
    """The sample is as large as its bound where enough labelled documents are there."""
    assert quality.SAMPLE_ROWS == toxicity.SAMPLE_ROWS == 4000
    docs = spark.range(20_000, 20_200).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.range(20_200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    there = docs.where(~held_out(F.col("doc_id"))).count()
    label = "quality" if module is quality else "toxic"
    assert labelled_sample(docs, labels, label, 100).count() == 100
    assert labelled_sample(docs, labels, label, 4000).count() == there
    assert labelled_sample(docs.union(docs), labels, label, 100).select("doc_id").distinct().count() == 100


def test_a_sample_is_bounded_in_rows(spark):
    """Rows that share a labelled id don't reach the driver all."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import labelled_sample

    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    got = labelled_sample(docs, labels, "quality", 10).collect()
    assert len(got) == 10 == len({r.doc_id for r in got})
    again = labelled_sample(docs.repartition(5), labels, "quality", 10).collect()
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in again}
