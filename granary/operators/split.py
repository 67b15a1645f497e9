"""Leakage-safe splitting: whole source groups go to train, val or test, and many trials are scored side by side."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.shared import Tables

SPLITS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)
#: Groups that a greedy trial places one by one; it draws the others, which are smaller.
LARGE = 1024


def group_payload(samples: DataFrame, group: str, key: str, cls: str) -> DataFrame:
    """(group, images, classes) with classes an array of (class, n, images): sums by group, not samples."""
    per = samples.groupBy(group, key, cls).agg(F.count(cls).alias("n"))
    images = per.groupBy(group, key).agg(F.lit(1).alias("one")).groupBy(group).agg(F.count("*").alias("images"))
    by_class = per.where(F.col(cls).isNotNull()).groupBy(group, cls).agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    classes = by_class.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(cls).alias("cls"), "n", "m"))).alias("classes")).withColumnRenamed(group, "_of")
    return images.join(classes, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")


def score(images: np.ndarray, counts: np.ndarray, presence: np.ndarray, ratios: tuple[float, ...] = RATIOS) -> float:
    """How far splits are from their shares, the lower the better; rows are splits.

    Four times the error in images, once that in instances and twice that in images by class, and three for each
    class that val or test lacks.
    """
    want = np.array(ratios)
    off = lambda x: np.abs(x / np.maximum(x.sum(0, keepdims=True), 1) - want.reshape(-1, *[1] * (x.ndim - 1)))
    lacking = ((counts[1:] == 0) & (counts.sum(0) > 0)).sum()
    return float(4 * off(images).sum() + off(counts).sum() + 2 * off(presence).sum() + 3 * lacking)


def ratio_score(samples: DataFrame, split: str, key: str, cls: str, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """One row (score): `score` of the splits that `samples` already have, from sums alone.

    Rows without a class count as images only; rows without one of SPLITS count in the totals. An empty table scores
    four, the images' whole error.
    """
    per = samples.groupBy(split, key, cls).agg(F.count(cls).alias("n"))
    off = lambda part, all_, ratio: F.abs(part / F.greatest(F.lit(1), all_) - ratio)
    total = lambda parts: sum(parts, F.lit(0.0))
    dealt = list(zip(SPLITS, ratios, strict=True))
    images = per.select(split, key).distinct().agg((4 * total(off(F.count_if(F.col(split) == s), F.count("*"), r) for s, r in dealt)).alias("score"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col(split) == s, F.col("n"))), F.lit(0))
    classes = per.where(F.col(cls).isNotNull()).groupBy(cls).agg(
        (total(off(of(s), F.sum("n"), r) + 2 * off(F.count_if(F.col(split) == s), F.count("*"), r) for s, r in dealt) + total(F.when(of(s) == 0, 3.0).otherwise(0.0) for s in SPLITS[1:])).alias("score")
    )
    return images.unionByName(classes.select("score")).agg(F.round(F.sum("score"), 6).alias("score"))


def _drawn(group: str, trial: Column, seed: int, ratios: tuple[float, ...]) -> Column:
    """The split that a trial draws for a group: a number, from a hash of both."""
    place = F.pmod(F.xxhash64(F.lit(seed), trial, F.col(group).cast("string")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.when(place < ratios[0], 0).when(place < ratios[0] + ratios[1], 1).otherwise(2)


def _place(large: list[np.ndarray], start: list[np.ndarray], totals: list[np.ndarray], seed: int, ratios: tuple[float, ...]) -> np.ndarray:
    """Greedy splits of the large groups: larger ones first, ties in random order, each to the split whose images,
    instances and images by class then deviate least from their targets, with fines for overfull ones.

    Each of `large`, `start` (what the splits have already) and `totals` holds images, instances and images by class.
    """
    draw, want = random.Random(seed), np.array(ratios)
    order = sorted(range(len(large[0])), key=lambda g: (-large[0][g], draw.random()))
    has = [x.copy() for x in start]
    goal = [np.multiply.outer(want, x) for x in totals]
    room = [np.maximum(x, 1.0) for x in goal]
    out = np.zeros(len(order), np.int64)
    for g in order:
        then = [h + x[g] for h, x in zip(has, large, strict=True)]
        off = [np.abs(t - x) / r for t, x, r in zip(then, goal, room, strict=True)]
        over = 0.8 * (then[1] > 1.25 * goal[1]).sum(1)
        over[0] = 0.0
        cost = off[0] + off[1].sum(1) + 1.5 * off[2].sum(1) + over + 2.0 * (then[0] > 1.2 * goal[0])
        s = out[g] = int(np.argmin(cost))
        for h, x in zip(has, large, strict=True):
            h[s] += x[g]
    return out


def search(samples: DataFrame, group: str, key: str, cls: str, trials: int = 2000, seed: int = 42, ratios: tuple[float, ...] = RATIOS, large: int = LARGE) -> DataFrame:
    """(group, split, score) of the best of `trials` random and `trials` greedy assignments; ties go to the earlier.

    A trial draws each group's split from a hash, so that its sums by split and class come from one pass over the
    groups' sums, whatever their number. Its greedy form draws all but the `large` largest groups and places these on
    top: only they and the scores are sent anywhere. Null groups are a group; an empty table gives an empty result.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    tables = Tables(samples.sparkSession)
    payload = tables.write(group_payload(samples, group, key, cls))
    top = payload.select(group, "images", "classes").orderBy(F.desc("images"), group).limit(large).collect()  # a bound number of rows
    last = top[-1] if len(top) == large else None
    size = F.struct((-F.col("images")).alias("n"), F.col(group).isNotNull().alias("named"), F.col(group).alias("g"))
    if last is None:
        is_top = F.lit(True)
    else:
        edge = F.struct(F.lit(-last["images"]).cast("long").alias("n"), F.lit(last[group] is not None).alias("named"), F.lit(last[group]).cast(dict(samples.dtypes)[group]).alias("g"))
        is_top = size <= edge
    names = [r[0] for r in payload.select(F.explode("classes.cls")).distinct().orderBy(F.col("col")).collect()]  # classes, which are few
    at = {c: k for k, c in enumerate(names)}
    of = lambda rows: [np.array([r["images"] for r in rows], float), *_by_class(rows, at)]
    told = of(top)
    tries = payload.select(group, "images", F.coalesce("classes", F.array().cast(dict(payload.dtypes)["classes"])).alias("classes"), is_top.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    tries = tries.withColumn("split", _drawn(group, F.col("trial"), seed, ratios))
    images = tries.groupBy("trial", "top", "split").agg(F.sum("images").alias("n")).select("trial", "top", "split", F.lit(-1).alias("cls"), "n", F.lit(0).cast("long").alias("m"))
    place = F.create_map(*[F.lit(x) for c in names for x in (c, at[c])]) if names else F.lit(None).cast(f"map<{dict(samples.dtypes)[cls]}, int>")
    parts = tries.select("trial", "top", "split", F.explode("classes").alias("c")).groupBy("trial", "top", "split", place[F.col("c.cls")].alias("cls")).agg(F.sum("c.n").alias("n"), F.sum("c.m").alias("m"))
    sums = images.unionByName(parts)
    n_classes = len(names)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        has = [np.zeros((2, 3)), np.zeros((2, 3, n_classes)), np.zeros((2, 3, n_classes))]
        for t, s, c, n, m in zip(pdf["top"].astype(int), pdf["split"], pdf["cls"], pdf["n"], pdf["m"], strict=True):
            if c < 0:
                has[0][t, s] = n
            else:
                has[1][t, s, c], has[2][t, s, c] = n, m
        trial = int(pdf["trial"].iloc[0])
        whole = [x.sum(0) for x in has]
        to = _place(told, [x[0] for x in has], [x.sum(0) for x in whole], seed + trial, ratios)
        greedy = [h[0] + np.stack([x[to == s].sum(0) for s in range(3)]) for h, x in zip(has, told, strict=True)]
        return pd.DataFrame({"trial": [2 * trial, 2 * trial + 1], "score": [score(*whole, ratios), score(*greedy, ratios)]})

    scores = sums.groupBy("trial").applyInPandas(judge, "trial long, score double")
    best = scores.agg(F.min(F.struct(F.round("score", 12).alias("score"), "trial")).alias("b")).first()["b"]
    if best is None:
        return samples.sparkSession.createDataFrame([], f"`{group}` {dict(samples.dtypes)[group]}, split string, score double")
    trial, greedy = divmod(best["trial"], 2)
    split = _drawn(group, F.lit(trial), seed, ratios)
    if greedy:
        rest = [np.zeros(3), np.zeros((3, n_classes)), np.zeros((3, n_classes))]
        for r in sums.where((F.col("trial") == trial) & ~F.col("top")).collect():  # a row for each split and class
            if r["cls"] < 0:
                rest[0][r["split"]] = r["n"]
            else:
                rest[1][r["split"], r["cls"]], rest[2][r["split"], r["cls"]] = r["n"], r["m"]
        all_ = [r.sum(0) + x.sum(0) for r, x in zip(rest, told, strict=True)]
        to = _place(told, rest, all_, seed + trial, ratios)
        chosen = samples.sparkSession.createDataFrame([(r[group], int(s)) for r, s in zip(top, to, strict=True)], f"_of {dict(samples.dtypes)[group]}, _to int")
        payload = payload.join(chosen, F.col(group).eqNullSafe(F.col("_of")), "left")
        split = F.coalesce("_to", split)
    named = F.array(*map(F.lit, SPLITS))[split]
    return payload.select(group, named.alias("split"), F.lit(float(best["score"])).alias("score"))


def _by_class(rows: list, at: dict) -> tuple[np.ndarray, np.ndarray]:
    counts, presence = np.zeros((len(rows), len(at))), np.zeros((len(rows), len(at)))
    for k, r in enumerate(rows):
        for c in r["classes"] or []:
            counts[k, at[c["cls"]]], presence[k, at[c["cls"]]] = c["n"], c["m"]
    return counts, presence


def by_hash(groups: DataFrame, group: str, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """Adds split from the group's hash: no search and no gathering, for any number of groups."""
    place = F.conv(F.substring(F.sha1(F.col(group).cast("string")), 1, 7), 16, 10).cast("long") / F.lit(float(16**7))
    return groups.withColumn("split", F.when(place < ratios[0], "train").when(place < ratios[0] + ratios[1], "val").otherwise("test"))
