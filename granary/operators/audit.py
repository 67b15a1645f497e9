"""Dataset audit: pairs that miss a side, class balance, histograms and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of `left` that `right` lacks."""
    return left.select(key).join(right.select(key).distinct(), key, "left_anti")


def class_balance(instances: DataFrame, split: str, cls: str, image: str) -> DataFrame:
    """(split, class, instances, images) for each split and, with a null split, over all."""
    # images are counted from (split, class, image) sums, so that no class gathers its images in one task's set
    per = instances.groupBy(split, cls, image).agg(F.count("*").alias("n"))
    by = per.groupBy(split, cls).agg(F.sum("n").alias("instances"), F.count("*").alias("images"))
    total = per.groupBy(cls, image).agg(F.sum("n").alias("n")).groupBy(cls).agg(F.sum("n").alias("instances"), F.count("*").alias("images"))
    return by.unionByName(total.withColumn(split, F.lit(None).cast(dict(by.dtypes)[split])))


def objects_histogram(instances: DataFrame, image: str) -> DataFrame:
    """(objects, images): how many images have how many objects; images without any are not counted."""
    return instances.groupBy(image).agg(F.count("*").alias("objects")).groupBy("objects").agg(F.count("*").alias("images"))


def totals(images: DataFrame, instances: DataFrame, key: str) -> DataFrame:
    """One row: images, labelled images, instances, and images without instances."""
    marked = images.select(key).join(instances.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return marked.agg(F.count("*").alias("images"), F.count("n").alias("labelled"), F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.count_if(F.col("n").isNull()).alias("without"))


def size_histogram(images: DataFrame, size: str = "size") -> DataFrame:
    return images.groupBy(size).agg(F.count("*").alias("images"))


def filled_balance(balance: DataFrame, splits: list[str], classes: list, split: str, cls: str) -> DataFrame:
    """`class_balance` with a row of zeros for each split, and the null one of totals, and each class that has none."""
    spark, kinds = balance.sparkSession, dict(balance.dtypes)
    grid = spark.createDataFrame([(s, c) for s in [*splits, None] for c in classes], f"_split {kinds[split]}, _cls {kinds[cls]}")  # two given lists
    told = grid.join(balance, F.col(split).eqNullSafe(F.col("_split")) & (F.col(cls) == F.col("_cls")), "left")
    return told.select(F.col("_split").alias(split), F.col("_cls").alias(cls), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instances", "images")])


def missing_names(images: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(side, key): what the report lists, images without a label file and label files without an image.

    One sum over both: a task holds two counts for each key, and no side is sorted or joined. Null keys meet nothing.
    """
    of = lambda df, n, m: df.select(key, F.lit(n).alias("_images"), F.lit(m).alias("_files"))
    met = of(images, 1, 0).unionByName(of(files, 0, 1)).groupBy(key).agg(F.sum("_images").alias("_images"), F.sum("_files").alias("_files"))
    alone = lambda side, own, other: F.when((F.col(other) == 0) | F.col(key).isNull(), F.array_repeat(F.lit(side), F.col(own).cast("int"))).otherwise(F.array())
    return met.select(F.explode(F.concat(alone("label", "_images", "_files"), alone("image", "_files", "_images"))).alias("side"), key)


def label_states(images: DataFrame, files: DataFrame, instances: DataFrame, key: str) -> DataFrame:
    """(state, images): images whose label file is missing, is empty, or has instances."""
    state = F.when(F.col("_file").isNull(), "missing").when(F.col("_n").isNull(), "empty").otherwise("labelled")
    marked = images.select(key).join(files.select(key).distinct().withColumn("_file", F.lit(True)), key, "left").join(instances.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    return marked.groupBy(state.alias("state")).agg(F.count("*").alias("images"))


def audit(images: DataFrame, files: DataFrame, instances: DataFrame, key: str, split: str, cls: str) -> dict[str, DataFrame]:
    """The whole report as tables: the parts stay distributed until they are shown."""
    return {"missing": missing_names(images, files, key), "states": label_states(images, files, instances, key), "classes": class_balance(instances, split, cls, key), "objects": objects_histogram(instances, key), "totals": totals(images, instances, key)}
