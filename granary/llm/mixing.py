"""Mixing sources to target weights by balanced sampling with the cube method.

A source taken `r` times on average takes each document floor(r) times, and once more with probability r - floor(r).
Those probabilities are rounded by the cube method's flight: a vector of probabilities moves inside the null space
of the balancing totals (documents and tokens) until hardly any is left between 0 and 1. Blocks of a source fly in
parallel; what each leaves over, two documents at most, flies on in larger blocks until one block of a source is
left, and landing settles its last two documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
BLOCK = 2048
_EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. `share` of all sizes is dealt out by weight;
    no target exceeds `limit` times its source's size, and the excess goes to the others by weight. Closed form: in
    the order of limit * size / weight, sources fill up one after the other while the level of the rest is above
    their own. Windows run over the table of sources alone, after aggregation.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    ratio = limit * F.col("source_size") / F.col("weight")
    full = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = totals.withColumn("weight", weight).withColumn("level", ratio)
    rows = rows.withColumns({"before": F.sum(limit * F.col("source_size")).over(full) - limit * F.col("source_size"), "heavy": F.sum("weight").over(rest), "all": F.sum("source_size").over(Window.partitionBy())})
    rows = rows.withColumn("even", (share * F.col("all") - F.col("before")) / F.col("heavy"))
    # the level of the first source, in order of its own level, that the even share doesn't fill
    even = F.min(F.when(F.col("level") > F.col("even"), F.struct("level", "even"))).over(Window.partitionBy())
    rows = rows.withColumn("line", even["even"])
    target = F.when(F.col("line").isNull(), limit * F.col("source_size")).otherwise(F.least(limit * F.col("source_size"), F.col("weight") * F.col("line")))
    return rows.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities within the null space of (1, size) until two at most are between 0 and 1.

    Three open documents at a time move together; either end of their line is taken with the chance that keeps each
    probability's expectation.
    """
    p, draw = p.astype(float).copy(), np.random.default_rng(seed)
    waiting = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()[::-1]
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            return p
        a, b, c = held
        x, y, z = float(size[a]), float(size[b]), float(size[c])
        u = (1.0, -1.0, 0.0) if x == y == z else (z - y, x - z, y - x)
        up = down = np.inf
        for k, v in zip(held, u, strict=True):
            if v:
                up = min(up, ((1 - p[k]) if v > 0 else p[k]) / abs(v))
                down = min(down, (p[k] if v > 0 else (1 - p[k])) / abs(v))
        step = up if draw.random() * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            q = p[k] + step * v
            p[k] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q
        held = [k for k in held if 0 < p[k] < 1]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles what the flight left: the choice whose tokens come closest to the expected ones, then documents."""
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    want, docs = float((p[left] * size[left]).sum()), float(p[left].sum())
    choices = [[m >> k & 1 for k in range(len(left))] for m in range(1 << len(left))]
    p[left] = min(choices, key=lambda c: (abs(float((np.array(c) * size[left]).sum()) - want), abs(sum(c) - docs), c))
    return np.round(p)


def _fly(rows: DataFrame, last: bool, level: int, seed: int) -> DataFrame:
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "nth"], kind="stable").reset_index(drop=True)
        key = f"{seed}/{level}/{pdf['source'][0]}/{pdf['block'][0]}"
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), size, zlib.crc32(key.encode()))
        return pdf.assign(p=landing(p, size) if last else p)

    return rows.groupBy("source", "block").applyInPandas(block, rows.schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source, nth, source_size, target, times, taken): how often the mix takes each row of `docs`.

    Size is the number of words. times is at most `limit` rounded up, taken = times * size. A source's taken words
    differ from its target by less than its largest document, whatever the number of blocks. A source without words
    is not taken. Reruns agree, whatever the partitions: rows of one doc_id, source and size are told apart by the running
    number nth (from 0), by which they spread over blocks like others. Null texts have size 0, null sources are one source, null
    ids are ids like others; an empty table gives an empty result, and other columns are not read. Sources are listed
    in one task once they are summed up, so they should be labels of the corpus, not as many as its documents.
    """
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source").groupBy("doc_id", "size", "source").agg(F.count("*").alias("n"))
    sized = sized.withColumn("nth", F.lit(0).cast("long"))
    for step in (1 << 40, 1 << 20, 1):  # equal rows one by one again, from short runs of numbers
        sized = sized.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
        sized = sized.withColumns({"n": F.least(F.col("n") - F.col("at"), F.lit(step).cast("long")), "nth": F.col("nth") + F.col("at")})
    sized = written(sized.select("doc_id", "size", "source", "nth"))
    targets = written(source_targets(sized, weights, share, limit).coalesce(1))
    known = targets.select(F.col("source").alias("_s"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long").alias("blocks"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(known, sized["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumns({"base": F.floor(rate + _EPS).cast("long"), "block": F.pmod(F.xxhash64("doc_id", "size", "nth"), "blocks")})
    rows = rows.withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    most, level, settled = targets.agg(F.max("n_docs")).first()[0] or 0, 0, None
    blocks = -(-most // block)
    now = rows
    while True:
        now = written(_fly(now, blocks <= 1, level, seed))
        if blocks <= 1:
            settled = now if settled is None else settled.unionByName(now)
            break
        done = now.where(f"p <= {_EPS} OR p >= {1 - _EPS}")
        settled = done if settled is None else settled.unionByName(done)
        now = now.where(f"p > {_EPS} AND p < {1 - _EPS}").withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long"))
        blocks, level = -(-blocks // (block // 2)), level + 1
    times = F.col("base") + F.round("p").cast("long")
    return settled.select("doc_id", "size", "source", "nth", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
