import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import classifier

GOOD = ["The river runs past the old mill and on to the sea.", "A letter came today from the north, and it was short."]
BAD = ["BUY NOW!! CHEAP!! GO!! BUY NOW!!", "spam### spam$$$ more%%% spam###"]


def corpus(spark, n=200):
    rows = [(i, f"{(GOOD if i % 3 else BAD)[i % 2]} {i % 17}", i % 3 != 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "l") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy_and_fold(spark):
    docs, labels = corpus(spark)
    model = classifier.train(docs, labels)
    made = classifier.classify(docs, model).withColumn("h", classifier.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert {r.doc_id for r in made if r.h} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((r.score >= 0.3) == (r.quality == 1) for r in made if r.h)
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope


def test_accuracy_on_the_held_out_rows_of_the_tables(spark):
    source = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels"))
    made = classifier.classify(docs, classifier.train(docs, labels)).join(labels, "doc_id").where(classifier.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in made)
    assert len(made) > 30 and right >= 0.95 * len(made)


def test_fit_is_bounded_and_repeatable(spark):
    docs, labels = corpus(spark, 120)
    several = docs.union(docs.withColumn("text", F.reverse("text"))).union(docs)
    one, other = classifier.train(several, labels), classifier.train(several.repartition(5), labels)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias
    small = classifier.train(docs, labels, fit_bytes=20_000)
    assert not np.array_equal(small.weights, classifier.train(docs, labels).weights)
    assert classifier.train(docs, labels, fit_bytes=0).score(np.zeros(0, np.int64)) == 0.5


def test_odd_rows(spark):
    docs, labels = corpus(spark, 60)
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 0), (999, 1)], "doc_id long, quality int"))
    model = classifier.train(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "é\U0001f600" * 5000, 1.0), (2, "é\U0001f600" * 5000, 1.0), (5, " \n ", 2.0)], "doc_id long, text string, score double")
    got = classifier.classify(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert classifier.classify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1)]])
def test_one_class_or_none(spark, labels):
    docs, _ = corpus(spark, 10)
    model = classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {round(r.score, 4) for r in classifier.classify(docs, model).collect()}
    assert scores == ({0.5} if not labels else {1.0})


def test_descent_reaches_the_optimum():
    """The hinge-loss primal at the solution is the dual's value, up to little."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w, b = classifier.dual_coordinate_descent(rows, values, y, 30, epochs=3000)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - t * (w[r] @ v + b)) for r, v, t in zip(rows, values, y))
    best = primal(w, b)
    for _ in range(200):
        assert best <= primal(w + rng.normal(size=30) * 0.05, b + rng.normal() * 0.05) + 1e-2


def test_repeats():
    raw = np.frombuffer(b" a bb a  bb\nbb c", np.uint8)
    assert classifier.repeats(raw).tolist() == [0, 0, 2, 2, 1, 0]
    assert classifier.repeats(np.frombuffer(b"  ", np.uint8)).tolist() == []
