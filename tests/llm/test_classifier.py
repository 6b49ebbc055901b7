"""Quadratic discriminant: algebra, edge cases, held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import classifier

TABLES = "/root/testdata/sf0.01"


def test_scores_are_gaussian_log_density_differences():
    r = np.random.default_rng(1)
    k = len(classifier.NAMES)
    x = [r.normal(c, 1 + c, (200, k)) for c in (0, 1)]
    total = {c: (200.0, x[c].sum(0), x[c].T @ x[c]) for c in (0, 1)}
    model = classifier.fit(total)
    pooled = np.diag((x[0].var(0) + x[1].var(0)) / 2)
    density = []
    for c in (0, 1):
        cov = (1 - classifier.SHRINKAGE) * np.cov(x[c].T, bias=True) + classifier.SHRINKAGE * pooled + classifier.FLOOR**2 * np.eye(k)
        d = x[0][:20] - x[c].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))
    assert np.allclose(model.score(x[0][:20]), want, atol=1e-8)


def test_sums_over_tasks(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(50, len(classifier.NAMES)))
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "label int, x array<double>").repartition(7)
    got = classifier.sums(rows)
    for c in (0, 1):
        own = x[c::2]
        assert got[c][0] == 25 and np.allclose(got[c][1], own.sum(0)) and np.allclose(got[c][2], own.T @ own)


def test_statistics_of_hard_texts():
    for t in [None, "", " \n\t", "a", "é😀", "w " * 50_000, "\x00", "!" * 1000]:
        x = classifier.statistics(t)
        assert len(x) == len(classifier.NAMES) and np.isfinite(x).all()


def test_hard_rows_one_class_no_labels(hard, spark, empty):
    feats = classifier.features(hard)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] + [(9, None, 0), (None, 1, 0), (4, 1, 0)], none.schema)
    for labels in (none, one):
        got = classifier.score(feats, classifier.train(feats, labels)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert classifier.features(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables not available")
def test_held_out_accuracy_and_no_held_out_label_is_learnt(spark):
    out = classifier.op8(spark, TABLES).cache()
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert out.count() == docs.count()
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    test = out.where("held_out").join(labels, "doc_id").cache()
    assert test.where(F.col("predicted") == F.col("quality")).count() >= 0.95 * test.count()
    feats = classifier.features(docs).cache()
    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.train(feats, x) for x in (labels, flipped))
    assert np.allclose(a.mean, b.mean) and np.allclose(a.inverse, b.inverse)
