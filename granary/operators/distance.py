"""Distance transform and ridge of masks given as pixels (keys, x, y): how far each pixel is from the background.

Two passes, one along each axis: windows over the columns' runs give the distance within the column, and a stream over
the rows' runs takes the least sum of squares over the run, as all columns of a run are at least that near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import components

#: Least distance of a ridge pixel, as a share of the mask's smaller side and within bounds; pixels of an axis.
RIDGE_SHARE, RIDGE_LEAST, RIDGE_MOST = 0.02, 1.0, 2.5


def _row_pass(g: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Least of g(x')^2 + (x - x')^2 over each row's run and the background beside it; runs are numbered in order."""
    n = len(g)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(first, n))
    at = np.arange(n) - np.repeat(first, size)
    square = g * g
    best = np.minimum(square, np.minimum(at + 1, np.repeat(size, size) - at) ** 2)
    step = 1
    while step * step < best.max(initial=0):
        same = run[step:] == run[:-step]
        left, right = square[:-step] + step * step, square[step:] + step * step
        best[step:] = np.where(same, np.minimum(best[step:], left), best[step:])
        best[:-step] = np.where(same, np.minimum(best[:-step], right), best[:-step])
        step += 1
    return best


def distance_transform(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, d2): the squared distance of each set pixel to the nearest one that isn't, exact.

    All that is not set is background, beyond the picture too. Repeated pixels count once, those without x or y are
    left out, null keys are a mask of their own. No task holds more than batches of pixels and a row's run.
    """
    set_ = pixels.select(*keys, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    column = set_.withColumn("_gap", F.col("y") - F.row_number().over(Window.partitionBy(*keys, "x").orderBy("y")))
    run = Window.partitionBy(*keys, "x", "_gap")
    g = F.least(F.col("y") - F.min("y").over(run), F.max("y").over(run) - F.col("y")) + 1
    told = column.select(*keys, "x", "y", g.cast("long").alias("_g"))
    own = [*keys, "y"]

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            before = pdf[own].shift()
            new = (pdf[own].ne(before) & ~(pdf[own].isna() & before.isna())).any(axis=1).to_numpy() | (pdf["x"].diff() != 1).to_numpy()
            new[:1] = True
            run = np.cumsum(new)
            whole = int(np.flatnonzero(new)[-1])  # the last run may go on
            rest, run, pdf = pdf.iloc[whole:], run[:whole], pdf.iloc[:whole]
            yield pdf[[*keys, "x", "y"]].assign(d2=_row_pass(pdf["_g"].to_numpy(np.int64), run))
        if rest is not None:
            yield rest[[*keys, "x", "y"]].assign(d2=_row_pass(rest["_g"].to_numpy(np.int64), np.zeros(len(rest), int)))

    kinds = dict(told.dtypes)
    return told.repartition(*own).sortWithinPartitions(*own, "x").mapInPandas(stream, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "x", "y")), "d2 long"]))


def ridge(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, d2): the medial axis as the distance's ridge: pixels with no farther neighbour along either axis or
    diagonal on both sides, and not nearer to the background than the mask's size asks for.

    A pixel is on the ridge where along at least one of the four lines through it neither neighbour is farther and one is nearer.
    """
    far = distance_transform(pixels, *keys)
    side = lambda c: F.max(c) - F.min(c) + 1
    bound = far.groupBy(*keys).agg(F.least(F.greatest(F.least(side("x"), side("y")) * RIDGE_SHARE, F.lit(RIDGE_LEAST)), F.lit(RIDGE_MOST)).alias("_least"))
    lines = ((1, 0), (0, 1), (1, 1), (1, -1))
    seen = F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.lit(s * dx).alias("dx"), F.lit(s * dy).alias("dy")) for k, (dx, dy) in enumerate(lines) for s in (1, -1)], F.struct(F.lit(-1).alias("l"), F.lit(0).alias("dx"), F.lit(0).alias("dy")))).alias("s")
    # each pixel tells its eight neighbours its distance; unset ones never ask
    told = far.select(*keys, "x", "y", "d2", seen).select(*keys, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "s.l", "d2")
    own = F.max(F.when(F.col("l") == -1, F.col("d2")))
    around = [F.array_sort(F.collect_list(F.when(F.col("l") == k, F.col("d2")))).alias(f"_l{k}") for k in range(len(lines))]  # two values at most
    met = told.groupBy(*keys, "x", "y").agg(own.alias("d2"), *around).where("d2 IS NOT NULL")
    on = lambda k: (F.coalesce(F.array_max(f"_l{k}"), F.lit(0)) <= F.col("d2")) & ((F.size(f"_l{k}") < 2) | (F.array_min(f"_l{k}") < F.col("d2")))
    peak = on(0) | on(1) | on(2) | on(3)
    same = F.lit(True)
    for i, k in enumerate(keys):
        bound = bound.withColumnRenamed(k, f"_k{i}")
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return met.where(peak).join(bound, same).where(F.sqrt("d2") >= F.col("_least")).select(*keys, "x", "y", "d2")


def nail_masks(pixels: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The largest component of each mask, and its ridge: what `skeleton.t_profile` measures nails by."""
    largest = components.largest_component(pixels, *keys)
    return largest, ridge(largest, *keys)
