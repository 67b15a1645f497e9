"""Morphology, holes and isolation of masks against NumPy on grids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import masks

SIDE = 40


def grid(pixels):
    out = np.zeros((SIDE, SIDE), bool)
    for x, y in pixels:
        out[y, x] = True
    return out


def around(mask, size):
    r = size // 2
    wide = np.pad(mask, r)
    return [wide[r + dy : r + dy + SIDE, r + dx : r + dx + SIDE] for dx, dy in masks.disk(size)]


def spread(start, through, diagonal):
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    while True:
        wide = np.pad(start, 1)
        more = start | through & np.logical_or.reduce([wide[1 + a : 1 + a + SIDE, 1 + b : 1 + b + SIDE] for a, b in steps])
        if (more == start).all():
            return start
        start = more


def largest(mask):
    left, best = mask.copy(), np.zeros_like(mask)
    while left.any():
        seed = np.zeros_like(mask)
        seed[tuple(np.argwhere(left)[0])] = True
        own = spread(seed, left, True)
        left &= ~own
        best = own if own.sum() > best.sum() else best
    return best


def refined(mask, beam):
    size = 5 if beam else 3
    mask = np.logical_or.reduce(around(np.logical_and.reduce(around(mask, 3)), 3))
    mask = np.logical_and.reduce(around(np.logical_or.reduce(around(mask, size)), size))
    corner = np.zeros_like(mask)
    corner[0, 0] = True
    mask = largest(~spread(corner, ~mask, False))
    return mask if mask.sum() >= (30 if beam else 20) else np.zeros_like(mask)


RNG = random.Random(7)
RING = [(x, y) for x in range(8, 30) for y in range(9, 28) if not (12 < x < 20 and 13 < y < 20) and RNG.random() < 0.97]
SHAPES = {1: RING + [(34, 34), (35, 34)], 2: [(x, y) for x in range(6, 33) for y in range(10, 24) if RNG.random() < 0.93], 3: [(9, 9), (9, 10)], None: [(x, y) for x in range(8, 12) for y in range(8, 30)]}


def frame(spark):
    return spark.createDataFrame([(k, x, y) for k, own in SHAPES.items() for x, y in [*own, own[0]]], "i int, x int, y int")


@pytest.mark.parametrize("beam", [False, True])
def test_refined_masks(spark, beam):
    got = {}
    for r in masks.refined(frame(spark), "i", beam=beam).collect():
        got.setdefault(r["i"], []).append((r["x"], r["y"]))
    for k, own in SHAPES.items():
        want = refined(grid(own), beam)
        assert (grid(got.get(k, [])) == want).all() and len(got.get(k, [])) == want.sum()


def test_erosion_and_dilation(spark):
    own = frame(spark).distinct()
    for size in (3, 5):
        for f, join in ((masks.eroded, np.logical_and), (masks.dilated, np.logical_or)):
            got = {(r["i"], r["x"], r["y"]) for r in f(own, "i", size=size).collect()}
            want = {(k, int(x), int(y)) for k, p in SHAPES.items() for y, x in np.argwhere(join.reduce(around(grid(p), size)))}
            assert got == want


def bricks(spark, n, side, step, per_row, cls="Brick"):
    return spark.createDataFrame([(1, k, cls, x + dx, y + dy) for k in range(n) for y, x in [(2 + k // per_row * step, 2 + k % per_row * step)] for dx in range(side) for dy in range(side)], "image int, instance int, cls string, x int, y int")


def test_apart_instances_stay_whole(spark):
    points = bricks(spark, 40, 8, 10, 8)
    assert masks.isolate(points, "image", "instance").count() == points.count()


def test_overlaps_go_but_for_dense_stacks(spark):
    few = bricks(spark, 20, 8, 5, 10)
    kept = masks.isolate(few, "image", "instance", "cls")
    inner = masks.eroded(few, "image", "instance")
    clash = few.alias("a").join(inner.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.instance") != F.col("b.instance")), "left_anti")
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in clash.collect()} and kept.count() < few.count()
    dense = bricks(spark, 90, 8, 5, 10)
    assert masks.isolate(dense, "image", "instance", "cls").count() == dense.count()
    assert masks.isolate(dense.withColumn("cls", F.lit("nail")), "image", "instance", "cls").count() < dense.count()
