"""Connected components: of any links, and of masks given as pixels (keys, x, y), eight neighbours each.

Masks become runs of pixels in a row, and those of a tile get their component in the task that holds the tile. Only what
touches across the sides of tiles is a link between components; labels spread over those by star contraction. A mask
within one tile needs no link, one of any size no more than its tiles' sides ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import pixel_tiles
from granary.operators.skeleton import degrees
from granary.shared import Tables


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node hands its larger, then its smaller neighbours to the least node that it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = up.groupBy("a").agg(F.min("b").alias("m"))
    down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) of every node of `links` (a, b) but those that are their component's least node themselves.

    Links have no direction and may repeat. Rounds take a logarithmic share of the longest path.
    """
    now = tables.write(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        after = tables.write(_stars(now))
        state = mark(after)
        tables.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node linked with each of the nodes 0 to n - 1: roots are hung under lesser ones, then paths shortened."""
    root = np.arange(n)
    while True:
        one, other = root[a], root[b]
        apart = one != other
        if not apart.any():
            return root
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after


def _labelled(keys: tuple[str, ...], diagonal: bool, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, reach, step = TaskContext.get().partitionId() << 33, int(diagonal), side + 4
        for batch, new, x, y in pixel_tiles.whole(batches, keys, repeats=False):
            first = np.flatnonzero(new | np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]))
            last = np.append(first[1:] - 1, len(x) - 1)
            code = pixel_tiles.codes(batch, new, x, y, side)
            start, end = code[first], code[last]
            low = np.searchsorted(end, start + step - reach, side="left")
            many = np.maximum(np.searchsorted(start, end + step + reach, side="right") - low, 0)
            upper = np.repeat(np.arange(len(first)), many)
            lower = np.arange(len(upper)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            label = number + _joined(len(first), upper, lower)
            number += len(first)
            at, to = pa.array(first), pa.array(last)
            columns = [*(batch.column(k).take(at) for k in keys), batch.column("y").take(at), batch.column("x").take(at), batch.column("x").take(to), pa.array(label)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "y", "x0", "x1", "label"])

    return run


def _across(found: DataFrame, *keys: str, diagonal: bool) -> DataFrame:
    """(a, b): labels of runs that touch at the sides of two tiles."""
    side, last = pixel_tiles.SIDE, pixel_tiles.SIDE - 1
    row, left, right = F.pmod("y", F.lit(side)), F.when(F.pmod("x0", F.lit(side)) == 0, F.col("x0")), F.when(F.pmod("x1", F.lit(side)) == last, F.col("x1"))
    edge = found.select(*keys, "y", "label", F.explode(F.when(row.isin(0, last), F.sequence("x0", "x1")).otherwise(F.array_distinct(F.array_compact(F.array(left, right))))).alias("x"))
    steps = [(1, 0), (0, 1), (1, 1), (-1, 1)] if diagonal else [(1, 0), (0, 1)]
    asked = edge.withColumn("s", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])))
    of = pixel_tiles.of
    asked = asked.where((of(F.col("x")) != of(F.col("s.x"))) | (of(F.col("y")) != of(F.col("s.y"))))
    asked = asked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("s.x").alias("_x"), F.col("s.y").alias("_y"), F.col("label").alias("a"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    return edge.join(asked, same).select("a", F.col("label").alias("b")).distinct()


def labelled_runs(pixels: DataFrame, *keys: str, tables: Tables, diagonal: bool = True) -> DataFrame:
    """(keys, y, x0, x1, label): a table of runs with their component; label is a number that its runs share, any number.

    Runs end at the sides of tiles. Repeated pixels count once.
    """
    placed = pixels.select(*keys, "x", "y", pixel_tiles.of(F.col("y")).alias("_ty"), pixel_tiles.of(F.col("x")).alias("_tx"))
    kinds = dict(placed.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "y")), f"x0 {kinds['x']}, x1 {kinds['x']}, label long"])
    found = tables.write(pixel_tiles.dealt(placed, *keys).mapInArrow(_labelled(keys, diagonal, pixel_tiles.SIDE), schema))
    links = tables.write(_across(found, *keys, diagonal=diagonal))
    if not links.head(1):
        return found
    of = connected(links, tables)
    return tables.write(found.join(of, F.col("label") == F.col("node"), "left").select(*keys, "y", "x0", "x1", F.coalesce("component", "label").alias("label")))


def component_table(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, top_y, top_x, pixels, x, y, left, right, bottom): each component of each mask, known by its first pixel in
    reading order, with its size, its centroid in whole pixels (halves to even) and its box.

    Pixels without x or y are left out; repeated ones count once; null keys are a mask of their own.
    """
    tables = Tables(pixels.sparkSession)
    own = pixels.where("x IS NOT NULL AND y IS NOT NULL")
    return tables.keep(_summed(labelled_runs(own, *keys, tables=tables), *keys))


def _summed(found: DataFrame, *keys: str) -> DataFrame:
    n = F.col("x1") - F.col("x0") + 1
    total = F.sum(n)
    x, y = F.sum((F.col("x0") + F.col("x1")) * n / 2) / total, F.sum(F.col("y") * n) / total
    first = F.min(F.struct("y", "x0"))
    whole = lambda c: F.bround(c, 0).cast("int")
    per = found.groupBy(*keys, "label").agg(first.alias("_top"), total.alias("pixels"), whole(x).alias("x"), whole(y).alias("y"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max("y").alias("bottom"))
    return per.select(*keys, F.col("_top.y").alias("top_y"), F.col("_top.x0").alias("top_x"), "pixels", "x", "y", "left", "right", "bottom")


def largest_component(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y): the pixels of each mask's largest component; of equal ones that of the first pixel in reading order."""
    tables = Tables(pixels.sparkSession)
    found = labelled_runs(pixels.where("x IS NOT NULL AND y IS NOT NULL"), *keys, tables=tables)
    per = found.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min(F.struct("y", "x0")).alias("top"))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "top", "label"))["label"].alias("label")).select("label")
    kept = found.join(best, "label", "left_semi")  # a label is one mask's
    return tables.keep(kept.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y"))


def ends_and_branches(skeleton: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, x, y, pixels): ends and branches of skeletons as centroids of touching pixels of that kind."""
    marked = degrees(skeleton, *keys).where("kind IN ('end', 'branch')").select(*keys, "kind", "x", "y")
    return component_table(marked, *keys, "kind").select(*keys, "kind", "x", "y", "pixels")
