"""Toxicity and quality: held-out accuracy on the table, and defined results on the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowquarry.llm import quality, toxicity
from rowquarry.llm.quality import op7_quality
from rowquarry.llm.toxicity import op5_toxicity

#: sf0.01 has six toxic documents among its held-out labels, too few to measure anything.
SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("query,label,cut,least", [(op5_toxicity, "toxic", 0.5, 0.9), (op7_quality, "quality", 0.3, 0.9)])
def test_held_out(spark, query, label, cut, least):
    got = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    held = [r for r in got if r.held_out and r[label] is not None]
    y, s = np.array([r[label] for r in held]), np.array([r.score for r in held])
    assert auc(s, y) >= least
    assert ((s >= cut) == (y == 1)).mean() >= 0.9
    assert (s >= cut)[y == 1].mean() >= 0.9 and (y == 1)[s >= cut].mean() >= 0.9  # recall, precision


def edge_frames(spark):
    nasty = ["you are a zzgrobb fool", "such a zzgrobb person", "zzgrobb zzgrobb away", "go zzgrobb yourself now"]
    fine = ["the meadow is green and wide today", "we walked home by the river", "tea is served at five o'clock", "he read the letter twice over"]
    docs, labels = [], []
    for k in range(80):
        bad = k % 2
        docs.append((k, (nasty if bad else fine)[k // 2 % 4] + f" {k}"))
        labels.append((k, 1 - bad, bad))
    docs += [(1000, None), (1001, ""), (1002, "   "), (1003, "x" * 100_000), (1004, "they zzgrobbed it"), (None, "no id"), (7, "repeated row"), (7, "repeated row")]
    labels += [(None, None, None), (5, None, None), (7, 0, 1), (99999, 1, 1)]
    docs = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit("clash")).withColumn("score", F.lit(2)).withColumn("role", F.lit(3))
    return docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))


def test_toxicity_edges(spark):
    docs, labels = edge_frames(spark)
    model = toxicity.train(docs, labels)
    got = {r.id: r.score for r in toxicity.scores(docs, model).collect()}
    assert len(got) == 86 and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == got[1002]
    assert min(got[k] for k in range(1, 80, 2) if k != 7) > max(got[k] for k in range(0, 80, 2))
    assert got[1004] > max(got[k] for k in range(0, 80, 2))  # an unseen form shares n-grams


@pytest.mark.parametrize("query", [op5_toxicity, op7_quality])
def test_queries_on_rows_without_an_id(spark, tmp_path, query):
    docs, labels = edge_frames(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == 88 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert all(r.held_out is not None and r.score is not None for r in got)


def test_a_bag_takes_the_most_toxic_words_of_the_whole_text():
    assert toxicity.picks(np.array([0, 1, 2, 399, 400, 4000])).tolist() == [0, 1, 2, 2, 3, 12]
    model = toxicity.Model(np.ones((toxicity.BUCKETS, 1)), np.array([[0.0], [1.0]]), -0.5)
    values = {w: v for w, v in zip("abcd", (3.0, 1.0, -1.0, -2.0), strict=True)}
    model._cache = dict(values)
    expected = 1 / (1 + np.exp(-(-0.5 + (3.0 + 1.0) / 2)))
    assert model.score("c a d b " + "d " * 30) == pytest.approx(expected)
    assert model.score("b") == pytest.approx(1 / (1 + np.exp(-0.5)))


def test_quality_edges(spark):
    docs, labels = edge_frames(spark)
    network = quality.train(docs, labels)
    got = {r.id: r.score for r in quality.scores(docs, network).collect()}
    assert len(got) == 86 and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == got[1002] == 0
    kept = quality.kept(docs, network)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_without_labels_or_rows(spark):
    docs, labels = edge_frames(spark)
    none = labels.where("false")
    assert toxicity.train(docs, none) is None and quality.train(docs, none) is None
    assert {r.score for r in toxicity.scores(docs, None).collect()} == {0.0}
    assert {r.id: r.score for r in quality.scores(docs, None).collect()}[3] == 1.0
    empty = docs.where("false")
    assert toxicity.train(empty, labels) is None and quality.train(empty, labels) is None
    assert toxicity.scores(empty, None).isEmpty() and quality.scores(empty, None).isEmpty() and quality.kept(empty, None).isEmpty()


def test_held_out_labels_are_not_used(spark):
    docs, labels = edge_frames(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, x) for x in (labels, other))
    assert np.array_equal(one.bucket_score, two.bucket_score)


def test_class_prior_is_near_the_truth():
    rng = np.random.default_rng(0)
    positive, web = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 1200), rng.normal(-2, 1, 2800)])
    assert abs(quality.class_prior(positive, web) - 0.3) < 0.08
