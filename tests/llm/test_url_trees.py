"""The URL trees: statistics that don't tell a row its own label, first splits by brute force, held-out agreement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import urls


def test_statistics_come_from_other_folds(spark):
    rows = [(f"h{k % 7}.x.org", k % 3 == 0, k % 5) for k in range(200)]
    frame = spark.createDataFrame([(h, h.split(".")[-1], ".".join(h.split(".")[-2:]), "en", int(y), f) for h, y, f in rows], "host string, suffix1 string, suffix2 string, folder string, y int, fold int")
    got = urls._with_statistics(frame, frame, 0.25, own=True).select("fold", "y", "f_suffix1", "f_suffix1_n", "f_folder").collect()
    for r in got:
        others = [y for _, y, f in rows if f != r["fold"]]
        assert r["f_suffix1"] == pytest.approx((sum(others) + 2.5) / (len(others) + 10)) == r["f_folder"]
        assert r["f_suffix1_n"] == pytest.approx(math.log2(len(others) + 1))
    assert len({(r["fold"], r["f_suffix1"]) for r in got}) == 5  # nothing but the fold shows


def test_first_split_by_brute_force(spark):
    rng = np.random.default_rng(8)
    x = {f: rng.integers(0, 6, 600).astype(float) for f in urls.FEATURES}
    y = ((x["f_digits"] > 3) ^ (rng.random(600) < 0.2)).astype(int)
    frame = spark.createDataFrame([(*(float(x[f][k]) for f in urls.FEATURES), int(y[k])) for k in range(600)], ", ".join(f"{f} double" for f in urls.FEATURES) + ", y int")
    start, trees = urls.fit_trees(frame, trees=1, depth=1)
    p = 1 / (1 + math.exp(-start))
    g, h = y - p, np.full(600, p * (1 - p))
    best = (0, None)
    for f in urls.FEATURES:
        for cut in range(5):
            low = x[f] <= cut
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, (f, float(cut), 0.4 * g[low].sum() / (h[low].sum() + 1), 0.4 * g[~low].sum() / (h[~low].sum() + 1))), key=lambda b: b[0])
    (tree,) = trees
    assert start == pytest.approx(math.log((y.sum() + 0.5) / (600 - y.sum() + 0.5)))
    assert (tree["feature"], tree["cut"]) == best[1][:2]
    assert (tree["left"]["value"], tree["right"]["value"]) == pytest.approx(best[1][2:])


def test_mixed_suffix_is_told_apart(spark):
    """One suffix, as many allowed as blocked urls: only features of the url itself can tell them apart."""
    rules = [("org", "/a", "allow"), ("org", "/b", "block")]
    host = F.concat(F.lit("h"), (F.floor(F.col("id") / 2) % 40).cast("string"), F.lit(".org"))
    frame = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host, F.when(F.col("id") % 2 == 0, F.concat(F.lit("/a"), F.col("id") % 9)).otherwise(F.concat(F.lit("/b"), F.repeat(F.lit("73"), 20)))).alias("url"))
    found = urls.held_out_agreement(frame, rules, folds=2).first()
    assert found["n"] > 500 and found["majority"] == pytest.approx(0.5, abs=0.1) and found["agreement"] > 0.95
    scores = urls.url_filter(frame, rules).groupBy("verdict").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r["verdict"]: r for r in scores}
    assert by["allow"]["hi"] < 0 < by["block"]["lo"]


def test_held_out_agreement_on_the_tables(spark):
    found = urls.held_out_agreement(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), folds=4).first()
    assert found["n"] > 400 and found["agreement"] > found["majority"] + 0.1
