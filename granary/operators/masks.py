"""Instance masks as pixel rows (keys, x, y): morphology by counting, holes and components by runs, isolation by coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import components
from granary.shared import Tables

#: From how many instances, and which share of bricks, an image is a dense stack.
DENSE_COUNT, DENSE_SHARE = 80, 0.8
#: Least pixels of a refined mask and width of its closing, by whether it is a beam.
LEAST, WIDTH = {True: 30, False: 20}, {True: 5, False: 3}


def disk(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic neighbourhood of an odd size; 3 is the cross."""
    r = size // 2
    return [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r + (r > 1) * r]


def _moved(points: DataFrame, keys: tuple[str, ...], shape: list[tuple[int, int]]) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shape])).alias("s")
    return points.select(*keys, "x", "y", steps).select(*keys, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


def eroded(points: DataFrame, *keys: str, size: int = 3) -> DataFrame:
    """Pixels whose whole neighbourhood is set: those that as many moved copies cover as it has places.

    `points` has each pixel once; beyond the picture nothing is set.
    """
    shape = disk(size)
    return _moved(points, keys, shape).groupBy(*keys, "x", "y").agg(F.count("*").alias("_n")).where(F.col("_n") == len(shape)).drop("_n")


def dilated(points: DataFrame, *keys: str, size: int = 3) -> DataFrame:
    return _moved(points, keys, disk(size)).distinct()


def filled(points: DataFrame, *keys: str) -> DataFrame:
    """Pixels with the holes of each mask: background that has no way to the edge of the mask's box, sideways or up and down.

    The background of a box is as large as the box: masks should be the size of objects.
    """
    tables = Tables(points.sparkSession)
    box = points.groupBy(*keys).agg(F.min("x").alias("_l"), F.max("x").alias("_r"), F.min("y").alias("_t"), F.max("y").alias("_b"))
    cells = box.withColumn("y", F.explode(F.sequence(F.col("_t") - 1, F.col("_b") + 1))).withColumn("x", F.explode(F.sequence(F.col("_l") - 1, F.col("_r") + 1)))
    same = F.lit(True)
    told = points.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("x").alias("_x"), F.col("y").alias("_y"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    free = tables.write(cells.select(*keys, "x", "y", "_t").join(told, same & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti"))
    found = components.labelled_runs(free, *keys, tables=tables, diagonal=False)
    # the component that holds the box's outer frame is outside; it begins in the row above the mask
    outside = found.join(box.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_t") - 1).alias("_first")), same & (F.col("y") == F.col("_first")), "left_semi").select("label").distinct()
    holes = found.join(outside, "label", "left_anti").select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    return tables.keep(points.select(*keys, "x", "y").unionByName(holes))


def refined(points: DataFrame, *keys: str, beam: bool = False) -> DataFrame:
    """Opened, closed, filled and largest component of each mask; masks that end with too few pixels are gone.

    `beam` closes wider gaps and asks for more pixels, as thin long shapes need. Repeated pixels count once.
    """
    tables = Tables(points.sparkSession)
    own = points.select(*keys, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    opened = dilated(eroded(own, *keys), *keys)
    closed = tables.write(eroded(dilated(opened, *keys, size=WIDTH[beam]), *keys, size=WIDTH[beam]))
    whole = components.largest_component(filled(closed, *keys), *keys)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    enough = whole.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST[beam]).drop("_n")
    return whole.join(enough, same, "left_semi")


def isolate(points: DataFrame, image: str, instance: str, cls: str | None = None) -> DataFrame:
    """Pixels of each instance that no other instance of the image covers after erosion.

    Coverage is one sum per pixel of an image, not a comparison of pairs. With `cls` given, images of at least 80
    instances, four fifths of them bricks, are left as they are.
    """
    cover = eroded(points, image, instance)
    total = cover.groupBy(image, "x", "y").agg(F.count("*").alias("_all"))
    own = cover.withColumn("_own", F.lit(1))
    marked = points.join(total, [image, "x", "y"], "left").join(own, [image, instance, "x", "y"], "left")
    free = F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0)) == 0
    if cls is not None:
        each = points.select(image, instance, cls).distinct()
        dense = each.groupBy(image).agg(((F.count("*") >= DENSE_COUNT) & (F.avg((F.lower(cls) == "brick").cast("int")) >= DENSE_SHARE)).alias("_dense"))
        marked, free = marked.join(dense, image), F.col("_dense") | free
    return marked.where(free).select(*points.columns)
