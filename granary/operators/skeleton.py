"""Skeleton graphs and line geometry of instances, given as rows of pixels (keys, x, y).

Degrees, lengths, axes and ends are joins and sums over pixel rows. Thinning, pruning and longest paths walk one
instance's graph at a time, which Spark groups by instance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.geometry import axis_angle, unit_axis
from granary.operators import pixel_tiles

_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def neighbours(pixels: DataFrame, *keys: str, half: bool = False) -> DataFrame:
    """(keys, x, y, dx, dy) for each pixel and each set one beside it; `half` gives each pair once."""
    steps = [s for s in _AROUND if not half or s > (0, 0)]
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("s")
    asked = pixels.select(*keys, "x", "y", moves).select(*keys, "x", "y", "s.dx", "s.dy", (F.col("x") + F.col("s.dx")).alias("_x"), (F.col("y") + F.col("s.dy")).alias("_y"))
    there = pixels.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    return asked.join(there, [*keys, "_x", "_y"]).select(*keys, "x", "y", "dx", "dy")


def _counted(keys: tuple[str, ...], side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new, x, y in pixel_tiles.whole(batches, keys):
            code = pixel_tiles.codes(batch, new, x, y, side)
            set_, own = np.unique(code), batch.column("_own").to_numpy(zero_copy_only=False)
            code, degree = code[own], np.zeros(int(own.sum()), np.int64)
            for dx, dy in _AROUND:
                asked = code + dy * (side + 4) + dx
                degree += set_[np.minimum(np.searchsorted(set_, asked), len(set_) - 1)] == asked
            rows = batch.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*keys, "x", "y")), pa.array(degree)], names=[*keys, "x", "y", "degree"])

    return run


def degrees(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, degree, kind): ends have one neighbour, branches three or more.

    Counted tile by tile; pixels at a tile's sides are known to the tiles beside it as well. Repeated pixels have a row
    each and count once as neighbours; those without x or y have none.
    """
    of, there = pixel_tiles.of, F.col("x").isNotNull() & F.col("y").isNotNull()
    beside = F.array_distinct(F.array(*[F.struct(of(F.col("y") + dy).alias("_ty"), of(F.col("x") + dx).alias("_tx")) for dx in (-1, 1) for dy in (-1, 1)]))
    own = (F.col("_t._ty") == of(F.col("y"))) & (F.col("_t._tx") == of(F.col("x")))
    placed = pixels.where(there).select(*keys, "x", "y", F.explode(beside).alias("_t")).select(*keys, "x", "y", "_t.*", own.alias("_own"))
    kinds = dict(pixels.dtypes)
    counted = pixel_tiles.dealt(placed, *keys).mapInArrow(_counted(keys, pixel_tiles.SIDE), ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "x", "y")), "degree long"]))
    out = counted.unionByName(pixels.where(~there).select(*keys, "x", "y", F.lit(0).cast("long").alias("degree")))
    return out.withColumn("kind", F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "end").when(F.col("degree") == 2, "path").otherwise("branch"))


def skeleton_length(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, length_px): 1 for straight and the root of 2 for diagonal pairs."""
    step = F.when((F.col("dx") != 0) & (F.col("dy") != 0), math.sqrt(2)).otherwise(1.0)
    sums = neighbours(pixels, *keys, half=True).groupBy(*keys).agg(F.sum(step).alias("s"))
    return pixels.select(*keys).distinct().join(sums, list(keys), "left").select(*keys, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("length_px"))


def principal_axis(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, cx, cy, angle_deg) of the direction of greatest spread."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), axis_angle(F.col("x"), F.col("y")).alias("angle_deg"))


def axis_line(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, angle_deg, length_px, first_x, first_y, last_x, last_y, status): the line through a mask's centre along
    its axis, as far as its pixels reach. Fewer than two pixels or equal ones give no line and a status to review."""
    axis = principal_axis(points, *keys).select(*keys, "cx", "cy", "angle_deg")
    c, s = unit_axis(F.col("angle_deg"))
    along = (F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s
    reach = points.join(axis, list(keys)).groupBy(*keys, "cx", "cy", "angle_deg").agg(F.min(along).alias("_lo"), F.max(along).alias("_hi"))
    put = {f"{end}_{way}": F.rint(F.round(F.col(f"c{way}") + F.col(to) * part, 6)).cast("int") for end, to in (("first", "_lo"), ("last", "_hi")) for way, part in (("x", c), ("y", s))}
    length = F.hypot(F.col("last_x") - F.col("first_x"), F.col("last_y") - F.col("first_y"))
    status = F.when(F.col("angle_deg").isNull(), "needs_review_no_clear_axis").otherwise("ok_clean_axis")
    return reach.withColumns(put).select(*keys, F.round("angle_deg", 6).alias("angle_deg"), F.round(F.coalesce(length, F.lit(0.0)), 6).alias("length_px"), *put, status.alias("status"))


def geometry_rows(points: DataFrame, cls: str, *keys: str) -> DataFrame:
    """(keys, cls, angle_deg, length_px, first_x, first_y, last_x, last_y, status), one row per instance to measure.

    `points` are pixels with their instance's class: I-beams get their longest path, nails tip and head, bricks
    nothing, all others, those without a class as well, their axis line. Case of the class name doesn't matter.
    """
    kind = F.lower(F.coalesce(F.col(cls), F.lit("")))
    shape = [*keys, cls, "angle_deg", "length_px", "first_x", "first_y", "last_x", "last_y", "status"]
    beams = beam_geometry(points.where(kind == "i-beam"), *keys, cls)
    nails = t_profile(points.where(kind == "nail"), *keys, cls).withColumnsRenamed({"tip_x": "first_x", "tip_y": "first_y", "head_x": "last_x", "head_y": "last_y"})
    others = points.where(~kind.isin("brick", "i-beam", "nail"))
    lines = axis_line(others.withColumn("_c", F.coalesce(F.col(cls), F.lit(""))), *keys, "_c").withColumn(cls, F.nullif(F.col("_c"), F.lit("")))
    return beams.select(shape).unionByName(nails.select(shape)).unionByName(lines.select(shape))


# Fixed values of the nail profile: share of the length and least and most pixels of an end band, percentiles that
# bound a band's width, shares of width and of length and least and most pixels of half a cap.
BAND_SHARE, BAND_LEAST, BAND_MOST = 0.18, 6.0, 28.0
WIDTH_FROM, WIDTH_TO = 0.08, 0.92
CAP_OF_WIDTH, CAP_OF_LENGTH, CAP_LEAST, CAP_MOST = 0.45, 0.045, 5.0, 18.0
AXIS_PIXELS, BAND_PIXELS = 4, 3


def t_profile(points: DataFrame, *keys: str, skeleton: DataFrame | None = None) -> DataFrame:
    """(keys, angle_deg, length_px, tip_x, tip_y, head_x, head_y, cap_x1, cap_y1, cap_x2, cap_y2, status) of nails.

    `points` are the pixels of each nail's largest component, `skeleton` those of its medial axis (by default all
    pixels), which give axis and centre. The band at either end that is wider across the axis is the head; equally
    wide ones, to six places, leave it at the lower end. The cap stands across the axis at the head's median. An axis
    of fewer than four pixels, equal pixels or a length of one or less give a length of 0, no points and a status to review.
    """
    axis = principal_axis(points if skeleton is None else skeleton, *keys)
    axis = axis.select(*keys, "cx", "cy", F.when(F.col("n") >= AXIS_PIXELS, F.col("angle_deg")).alias("angle_deg"))
    c, s = unit_axis(F.col("angle_deg"))
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    placed = points.select(*keys, "x", "y").join(axis, list(keys)).select(*keys, (x * c + y * s).alias("_u"), (y * c - x * s).alias("_v"))
    extent = placed.groupBy(*keys).agg(F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    band = F.least(F.greatest((F.col("_hi") - F.col("_lo")) * BAND_SHARE, F.lit(BAND_LEAST)), F.lit(BAND_MOST))
    within = F.array_compact(F.array(F.when(F.col("_u") <= F.col("_lo") + band, 0), F.when(F.col("_u") >= F.col("_hi") - band, 1)))
    ends = placed.join(extent, list(keys)).select(*keys, "_u", "_v", "_lo", "_hi", F.explode(within).alias("_end"))
    full = F.count("*") >= BAND_PIXELS
    edge = F.when(F.col("_end") == 0, F.first("_lo")).otherwise(F.first("_hi"))
    bands = ends.groupBy(*keys, "_end").agg(
        F.when(full, F.percentile("_v", WIDTH_TO) - F.percentile("_v", WIDTH_FROM)).otherwise(0.0).alias("_w"),
        F.when(full, F.percentile("_v", 0.5)).otherwise(0.0).alias("_mid"),
        F.when(full, F.percentile("_u", 0.5)).otherwise(edge).alias("_cap"),
    )
    head = bands.groupBy(*keys).agg(F.max(F.struct(F.round("_w", 6).alias("r"), (-F.col("_end")).alias("o"), "_w", "_mid", "_cap")).alias("_h"))
    rows = axis.join(extent, list(keys), "left").join(head, list(keys), "left").withColumn("_len", F.col("_hi") - F.col("_lo"))
    clear = F.col("angle_deg").isNotNull() & (F.col("_len") > 1)
    tip = F.when(F.col("_h.o") == 0, F.col("_hi")).otherwise(F.col("_lo"))
    half = F.least(F.greatest(F.col("_h._w") * CAP_OF_WIDTH, F.col("_len") * CAP_OF_LENGTH, F.lit(CAP_LEAST)), F.lit(CAP_MOST))
    spots = {"tip": (tip, F.lit(0.0)), "head": (F.col("_h._cap"), F.col("_h._mid")), "cap1": (F.col("_h._cap"), F.col("_h._mid") - half), "cap2": (F.col("_h._cap"), F.col("_h._mid") + half)}
    pixel = lambda v: F.when(clear, F.rint(F.round(v, 6)).cast("int"))
    named = lambda name, way: f"{name[:3]}_{way}{name[3:]}" if name[3:].isdigit() else f"{name}_{way}"
    put = {}
    for name, (u, v) in spots.items():
        put[named(name, "x")] = pixel(F.col("cx") + u * c - v * s)
        put[named(name, "y")] = pixel(F.col("cy") + u * s + v * c)
    rows = rows.withColumns(put)
    length = F.hypot(F.col("head_x") - F.col("tip_x"), F.col("head_y") - F.col("tip_y"))
    status = F.when(clear, "ok_t_profile_skeleton").otherwise("needs_review_no_clear_t_profile")
    return rows.select(*keys, F.round("angle_deg", 6).alias("angle_deg"), F.round(F.coalesce(length, F.lit(0.0)), 6).alias("length_px"), *put, status.alias("status"))


def _beside(points: set, p: tuple[int, int]) -> list[tuple[int, int]]:
    return [q for dx, dy in _AROUND if (q := (p[0] + dx, p[1] + dy)) in points]


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        before = m.copy()
        for odd in (0, 1):
            n, e, s, w = m[:-2, 1:-1], m[1:-1, 2:], m[2:, 1:-1], m[1:-1, :-2]
            ring = [n, m[:-2, 2:], e, m[2:, 2:], s, m[2:, :-2], w, m[:-2, :-2]]
            total = sum(x.astype(int) for x in ring)
            rises = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            open_ = (n * e * s == 0) & (e * s * w == 0) if not odd else (n * e * w == 0) & (n * s * w == 0)
            m[1:-1, 1:-1][(m[1:-1, 1:-1] == 1) & (total >= 2) & (total <= 6) & (rises == 1) & open_] = 0
        if (m == before).all():
            return m[1:-1, 1:-1].astype(bool)


def prune(points: set[tuple[int, int]], longest: float = 4.0) -> set[tuple[int, int]]:
    """Takes off side branches of at most this length until none is left; a lone path stays.

    Branches are followed over the four straight neighbours, so that no diagonal cuts a junction short.
    """
    points = set(points)
    beside = lambda p: [q for dx, dy in _AROUND if not (dx and dy) and (q := (p[0] + dx, p[1] + dy)) in points]
    while True:
        gone: set[tuple[int, int]] = set()
        for end in sorted(p for p in points if len(beside(p)) == 1):
            walk, length, last = [end], 0.0, None
            while True:
                ahead = [q for q in beside(walk[-1]) if q != last and q not in walk]
                if len(ahead) != 1:
                    break
                last = walk[-1]
                length += math.dist(last, ahead[0])
                if len(beside(ahead[0])) > 2:
                    if length <= longest:
                        gone |= set(walk)
                    break
                walk.append(ahead[0])
        if not gone:
            return points
        points -= gone


def longest_path(points: set[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
    """The longest of the shortest paths between two ends; equal lengths go to the smaller ends.

    With fewer than two ends any two points may be a path's; without a path, as of lone points, it is (0, []).
    """

    def reach(start: tuple[int, int]) -> tuple[dict, dict]:
        far, came, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            d, p = heapq.heappop(heap)
            if d > far[p]:
                continue
            for q in _beside(points, p):
                e = d + math.dist(p, q)
                if e < far.get(q, math.inf) - 1e-12:
                    far[q], came[q] = e, p
                    heapq.heappush(heap, (e, q))
        return far, came

    best: tuple[float, list] = (0.0, [])
    ends = sorted(p for p in points if len(_beside(points, p)) == 1)
    if len(ends) < 2:
        ends = sorted(points)
    found = False
    for start in ends:
        far, came = reach(start)
        for end in ends:
            if end > start and end in far and (not found or far[end] > best[0] + 1e-9):
                path = [end]
                while path[-1] != start:
                    path.append(came[path[-1]])
                best, found = (far[end], path[::-1]), True
    return best


def _direction(points: np.ndarray) -> float | None:
    """The angle of greatest spread in (-90, 90] degrees; none for equal points."""
    (xx, xy), (_, yy) = np.cov(points, rowvar=False)
    if not xx + yy:
        return None
    angle = math.degrees(math.atan2(2 * xy + 0.0, xx - yy) / 2)
    return angle + 180 if angle <= -90 else angle


def beam_geometry(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_pixels, length_px, angle_deg, first_x, first_y, last_x, last_y, n_ends, n_branches, status) of I-beam masks given by their pixels.

    A mask is thinned, pruned (unless fewer than two pixels are left) and measured along its longest path, or by its
    whole length and its extremes along the axis where it has no path. Branches are counted before pruning, ends
    after it. The status tells whether there were branches and whether pruning took any off. Masks of fewer than 50
    pixels and skeletons of fewer than two have a length of 0 and neither angle nor ends.
    """
    kinds = dict(pixels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, length, angle, spots, ends, branches = len(pdf), 0.0, None, [None] * 4, 0, 0
        status = "skipped_small_mask"
        if n >= 50:
            x, y = pdf["x"].to_numpy(int), pdf["y"].to_numpy(int)
            mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
            mask[y - y.min(), x - x.min()] = True
            raw = {(int(b), int(a)) for a, b in zip(*np.nonzero(thin(mask)), strict=True)}
            pruned = prune(raw)
            kept = pruned if len(pruned) >= 2 else raw
            branches = sum(len(_beside(raw, p)) >= 3 for p in raw)
            ends = sum(len(_beside(kept, p)) == 1 for p in kept)
            status = "skeleton_too_short"
            if len(kept) >= 2:
                length, path = longest_path(kept)
                points = np.array(path or sorted(kept), float)
                angle = _direction(points)
                if not path:
                    length = sum(math.dist(p, q) for p in kept for q in _beside(kept, p)) / 2
                    along = points @ [math.cos(math.radians(angle)), math.sin(math.radians(angle))]
                    points = points[[along.argmin(), along.argmax()]]
                spots = [int(v) for point in (points[0], points[-1]) for v in point + [x.min(), y.min()]]
                status = "ok" if not branches else "ok_pruned_main_path" if len(pruned) < len(raw) else "branched_needs_review"
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], n, length, angle, *spots, ends, branches, status]], columns=[*keys, "n_pixels", "length_px", "angle_deg", "first_x", "first_y", "last_x", "last_y", "n_ends", "n_branches", "status"])

    own = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return pixels.groupBy(*keys).applyInPandas(run, f"{own}, n_pixels long, length_px double, angle_deg double, first_x int, first_y int, last_x int, last_y int, n_ends long, n_branches long, status string")
