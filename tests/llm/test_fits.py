"""Fits against brute force: the line field's gradient by enumeration, the ordinal model's likelihood by definition."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import quality_classifier, quality_rules


def test_crf_gradients_by_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([1, 4, 0, 3, 5])
    features = rng.integers(0, 6, (counts.sum(), 3)).astype(np.uint8)
    labels = rng.integers(0, 2, counts.sum())
    rate, ridge = 0.5, 1e-3
    weights, transition = np.zeros(quality_rules._SIZE), np.zeros((2, 2))
    often = np.bincount(features.ravel(), minlength=quality_rules._SIZE)
    starts = np.concatenate([[0], np.cumsum(counts)])
    links = sum(max(0, c - 1) for c in counts)
    for _ in range(6):
        grad, pairs = np.zeros(quality_rules._SIZE), np.zeros((2, 2))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if s == e:
                continue
            every, power = list(itertools.product((0, 1), repeat=e - s)), []
            for y in every:
                power.append(sum(weights[features[s + t]].sum() for t in range(e - s) if y[t]) + sum(transition[y[t], y[t + 1]] for t in range(e - s - 1)))
            p = np.exp(np.array(power) - np.logaddexp.reduce(power))
            for y, share in [(labels[s:e], 1.0), *((y, -q) for y, q in zip(every, p, strict=True))]:
                for t in range(e - s):
                    np.add.at(grad, features[s + t], share * y[t])
                    if t:
                        pairs[y[t - 1], y[t]] += share
        weights += rate * (grad / (0.05 * often + 20) - ridge * weights)
        transition += rate * (pairs / (0.25 * max(1, links) + 20) - ridge * transition)
    got = quality_rules.fit_crf(features, counts, labels, rounds=6)
    assert got[0] == pytest.approx(weights, abs=1e-10) and got[1] == pytest.approx(transition, abs=1e-10)


def loss(weights, cuts, features, values, counts, grades, ridge=2e-4):
    total, at = 0.0, 0
    for n, g in zip(counts, grades, strict=True):
        score = sum(weights[f] * v for f, v in zip(features[at : at + n], values[at : at + n], strict=True)) / max(1, n) ** 0.25
        above = [1.0, *(1 / (1 + np.exp(c - score)) for c in cuts), 0.0]
        total -= np.log(above[g] - above[g + 1])
        at += n
    return total / len(grades) + ridge / 2 * float((weights**2).sum())


def test_ordinal_fit_is_a_least_loss():
    rng = np.random.default_rng(9)
    n, own = 150, 8
    counts = rng.integers(1, 6, n)
    features, values = rng.integers(0, own, counts.sum()), rng.random(counts.sum()) + 0.5
    truth = np.linspace(-2, 2, own)
    owner = np.repeat(np.arange(n), counts)
    score = np.bincount(owner, truth[features] * values, n) / counts**0.25 + rng.logistic(size=n)
    grades = (score > -0.5).astype(int) + (score > 1)
    model = quality_classifier.fit_model(features, values, counts, grades, rounds=1500, rate=0.02)
    assert (np.diff(model.cuts) > 0).all() and not model.weights[own:].any()
    at = lambda w, c: loss(np.concatenate([w, np.zeros(0)]), c, features, values, counts, grades)
    least, w = at(model.weights[:own], model.cuts), model.weights[:own]
    for k in range(own):
        step = np.eye(own)[k] * 1e-4
        assert abs(at(w + step, model.cuts) - at(w - step, model.cuts)) / 2e-4 < 5e-3
    for k in range(2):
        step = np.eye(2)[k] * 1e-4
        assert abs(at(w, model.cuts + step) - at(w, model.cuts - step)) / 2e-4 < 5e-3
    for _ in range(50):
        assert at(w + rng.normal(0, 0.3, own), model.cuts) > least


def test_scores_are_the_models(spark):
    """Expected grade and tail probability, recomputed from the features."""
    model = quality_classifier.OrdinalModel(np.sin(np.arange(quality_classifier.SIZE)), np.array([-0.3, 0.8]))
    texts = ["one two three two", "", None, "x " * 5000 + "y"]
    rows = quality_classifier.quality_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).orderBy("doc_id").collect()
    import pyarrow as pa

    features, values, counts = quality_classifier.text_features(pa.array(texts))
    ends = np.cumsum(counts)
    for r, n, e in zip(rows, counts, ends, strict=True):
        score = float((model.weights[features[e - n : e]] * values[e - n : e]).sum()) / max(1, n) ** 0.25
        above = [1 / (1 + np.exp(c - score)) for c in model.cuts]
        assert r["expected_grade"] == pytest.approx(sum(above)) and r["tail_probability"] == pytest.approx(above[1])


def test_spliced_documents_come_out_mixed(spark):
    """Half a good and half a bad document: most get lines of both labels."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.size(F.split("text", "\n")) >= 6)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    per = {q: [r["text"].split("\n") for r in docs.join(labels.where(f"quality = {q}"), "doc_id").orderBy("doc_id").limit(30).collect()] for q in (0, 1)}
    spliced = [(k, "\n".join([*good[:12], *bad[:12]])) for k, (good, bad) in enumerate(zip(per[1], per[0], strict=False))]
    model = quality_rules.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels)
    rows = quality_rules.quality_rules(spark.createDataFrame(spliced, "doc_id long, text string"), model=model).collect()
    mixed = sum(0 < r["content_lines"] < r["n_lines"] for r in rows)
    assert len(rows) >= 20 and mixed >= 0.6 * len(rows)
