"""Samples: images with their label files, splits put together, class names and lookups by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import points_text


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """All splits as one table with a column `split`; columns that a split lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("split", F.lit(name)) for name, df in parts.items()])


def collect_samples(images: DataFrame, files: DataFrame, key: str, path: str) -> DataFrame:
    """`images` with the columns of their label files; an image without one ends the job with its path.

    Both sides meet on `key`, of which `files` has at most one row each.
    """
    joined = images.join(files.withColumn("_found", F.lit(True)), key, "left")
    lacks = F.raise_error(F.concat(F.lit("no label file for "), F.coalesce(F.col(path).cast("string"), F.lit("an image without a path"))))
    # a filter, so that no choice of columns prunes the check
    return joined.where(F.coalesce("_found", lacks.cast("boolean"))).drop("_found")


def named(instances: DataFrame, names: DataFrame, class_id: str, name: str) -> DataFrame:
    """`instances` with the class's name from `names` (class id, name); an unknown id is its own name."""
    return instances.join(names.select(class_id, name), class_id, "left").withColumn(name, F.coalesce(name, F.col(class_id).cast("string")))


def class_count(counts: DataFrame, key: str, cls: str, n: str, target: str, order: str) -> DataFrame:
    """(key, n): the count of the first class, by `order`, whose name is `target` but for case; 0 where there is none."""
    hit = F.lower(cls) == target.lower()
    return counts.groupBy(key).agg(F.coalesce(F.min_by(F.when(hit, F.col(n)), F.when(hit, F.col(order))), F.lit(0)).alias(n))


def label_images(files: DataFrame, images: DataFrame, stem: str, ending: str, endings: list[str]) -> DataFrame:
    """`files` with the ending of the image of that stem: the first in the order of `endings` that exists, else null."""
    rank = F.array_position(F.array(*map(F.lit, endings)), F.lower(ending))
    first = images.where(rank > 0).groupBy(stem).agg(F.min(F.struct(rank.alias("rank"), F.col(ending).alias(ending)))[ending].alias(ending))
    return files.join(first, stem, "left")


def first_by_path(rows: DataFrame, path: str, n: int = 20) -> DataFrame:
    """The `n` first rows by path, as reports show them."""
    return rows.orderBy(path).limit(n)


def cache_key(content: Column, model: Column, conf: Column, iou: Column, size: Column, preprocess: Column) -> Column:
    """What tells one inference from another: the content's digest and the settings, thresholds to six places."""
    return F.struct(F.sha1(content).alias("digest"), F.coalesce(model, F.lit("")).alias("model"), F.round(conf, 6).alias("conf"), F.round(iou, 6).alias("iou"), size.cast("int").alias("size"), F.coalesce(preprocess, F.lit(False)).alias("preprocess"))


def geometry_rows(items: DataFrame) -> DataFrame:
    """The table of measured shapes: branch points are N/A where the method follows no skeleton.

    `items` has instance_id, detection_index, class, confidence, length_px, angle_deg, geometry_method, status and
    the arrays endpoints and branch_points of (x, y). Column names are fixed values.
    """
    method = F.coalesce("geometry_method", F.lit("clean_overlay"))
    followed = method.contains("longest_path") | method.contains("skeleton")
    return items.select(
        F.col("instance_id").alias("Instance"), F.col("detection_index").alias("Detection Index"), F.col("class").alias("Class"), F.col("confidence").alias("Confidence"),
        F.col("length_px").alias("Length (px)"), F.col("angle_deg").alias("Angle (deg)"), method.alias("Method"), points_text(F.col("endpoints")).alias("Endpoints"), F.size("endpoints").alias("Endpoint Count"),
        F.when(followed, points_text(F.col("branch_points"))).otherwise("N/A").alias("Branch Points"), F.when(followed, F.size("branch_points").cast("string")).otherwise("N/A").alias("Branch Point Count"), F.col("status").alias("Status"),
    )


def class_rows(rows: DataFrame, target: str, cls: str = "Class") -> DataFrame:
    """One row (n): how many measured shapes are of the class, but for case; 0 for none."""
    return rows.agg(F.count_if(F.lower(cls) == target.lower()).alias("n"))
