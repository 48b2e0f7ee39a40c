import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import ftrl, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
    n1 = labels.sum()
    return (ranks[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(labels) - n1))


def test_ftrl_learns_a_linear_rule_and_keeps_useless_weights_at_zero():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        ids = np.unique(rng.integers(0, 50, 8))
        rows.append((ids, np.ones(len(ids)), float((ids < 5).any()), 1.0))
    model = ftrl.train(rows, 64, l1=1.0)
    predicted = [model.bias + model.weights[i].sum() > 0 for i, _, _, _ in rows]
    assert np.mean([p == bool(y) for p, (_, _, y, _) in zip(predicted, rows)]) > 0.97
    assert (model.weights[50:] == 0).all()
    assert ftrl.train([], 8).score(np.zeros(1))[0] == 0.5


@pytest.mark.parametrize("module, label, folds, held, least", [(quality_classifier, "quality", 4, 2, 0.97), (toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, module, label, folds, held, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 30_000)], "doc_id long, text string")
    model = module.fit(docs, labels)
    rows = docs.select("doc_id", "text").unionByName(odd).withColumn("Score", F.lit("own"))
    out = module.score(rows, model).withColumn("held", quality_classifier.in_fold(F.col("doc_id"), folds, held)).toPandas()
    assert len(out) == docs.count() + 3 and out["score"].between(0, 1).all()
    both = out[out["held"]].merge(labels.toPandas(), on="doc_id")
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) > least


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_without_labels_or_documents(spark, module):
    docs = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    assert module.score(docs, model).count() == 2
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_label_model_recovers_accuracies_and_sees_a_correlation():
    rng = np.random.default_rng(2)
    n, hit, false = 20_000, [0.9, 0.8, 0.7, 0.85], [0.01, 0.02, 0.03, 0.01]
    y = rng.random(n) < 0.1
    votes = np.stack([np.where(y, rng.random(n) < h, rng.random(n) < f) for h, f in zip(hit, false)], axis=1)
    copy = np.where(rng.random(n) < 0.9, votes[:, 2], rng.random(n) < 0.05)[:, None]
    patterns, counts = np.unique(np.concatenate([votes, copy], axis=1).astype(int), axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float))
    post = model.posterior(np.concatenate([votes, copy], axis=1).astype(int))
    assert ((post > 0.5) == y).mean() > 0.98
    assert model.parents[4] == 2 or model.parents[2] == 4
    assert abs(model.prior - 0.1) < 0.02


def test_lexicons_hold_what_only_toxic_texts_have(spark):
    toxic = [f"the fine {w} goes by grumpel{k} and grumpel{k + 1}" for k, w in enumerate(["zonk", "blarg"] * 30)]
    clean = [f"the fine day goes by number{k % 7}" for k in range(300)]
    known = spark.createDataFrame([(t, 1.0) for t in toxic] + [(t, 0.0) for t in clean], "text string, label double")
    found = frozenset().union(*toxicity.lexicons(known))
    assert found and all(t.startswith(("grum", "zonk", "blarg")) for t in found)


def test_toxic_documents_go_and_columns_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.withColumn("score", F.lit(1)).withColumn("toxic_score", F.lit("own"))
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    by = {r["toxic"]: r["n"] for r in kept.join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all_ = {r["toxic"]: r["n"] for r in docs.join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert by[0] >= 0.97 * all_[0] and by.get(1, 0) <= 0.3 * all_[1]


def test_a_labelled_id_that_many_rows_share_is_one_row_for_the_driver(spark):
    from vellumine.llm import quality_classifier, toxicity

    docs = spark.createDataFrame([(1, f"some text {i % 7}") for i in range(3000)] + [(2, "other words")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    rows = quality_classifier.one_text_each(docs, sample)
    assert rows.count() == 2 and rows.first()["text"] == quality_classifier.one_text_each(docs.repartition(5), sample).first()["text"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 3001
