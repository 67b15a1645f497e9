"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_angle(angle: Column) -> Column:
    """An angle of a line in (-90, 90] degrees."""
    return F.when(angle > 90, angle - 180).when(angle <= -90, angle + 180).otherwise(angle)


def axis_angle(x: Column, y: Column) -> Column:
    """Aggregate: direction of the greatest spread of points, in (-90, 90] degrees; null for fewer than two or equal ones."""
    cov, spread = F.covar_samp(x, y), F.var_samp(x) - F.var_samp(y)
    angle = F.degrees(0.5 * F.atan2(2 * cov + F.lit(0.0), spread))
    return F.when((F.count("*") >= 2) & (F.var_samp(x) + F.var_samp(y) > 0), F.when(angle <= -90, angle + 180).otherwise(angle))


def unit_axis(angle: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(angle)), F.sin(F.radians(angle))


def clip(value: Column, size: Column) -> Column:
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), size - 1).cast("int")


def polyline_length(xs: Column, ys: Column) -> Column:
    """Length of a line through points given by two arrays."""
    n = F.size(xs)
    pairs = F.sequence(F.lit(1), n - 1)
    step = F.transform(pairs, lambda k: F.sqrt(F.pow(F.get(xs, k) - F.get(xs, k - 1), 2) + F.pow(F.get(ys, k) - F.get(ys, k - 1), 2)))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(step, F.lit(0.0), lambda a, s: a + s))


def tile_starts(size: Column, tile: int = 640, overlap: float = 0.2) -> Column:
    """Starts of tiles along one side; the last tile is flush with the edge, a short side has one tile."""
    step = int(tile * (1 - overlap))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), size - tile + 1) - 1, F.lit(step))
    return F.when(F.element_at(starts, -1) < size - tile, F.concat(starts, F.array(F.greatest(F.lit(0), size - tile)))).otherwise(starts)
