"""Minority oversampling: copies of images that hold a class of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oversample(images: DataFrame, instances: DataFrame, key: str, cls: str, targets: list, copies: int = 3) -> DataFrame:
    """`images` with a column copy_no: 0 for the image itself, 1 .. copies for those that hold a target class."""
    rich = instances.where(F.col(cls).isin(targets)).select(key).distinct().withColumn("_rich", F.lit(True))
    marked = images.join(rich, key, "left")
    return marked.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.when(F.col("_rich"), copies).otherwise(0)))).drop("_rich")


def balanced(images: DataFrame, instances: DataFrame, key: str, cls: str, targets: list, splits: list[str], copies: int = 3) -> DataFrame:
    """`oversample` for the images of some splits, and output_name: stem, `_bal` and the copy's number, ending.

    `images` has split and file_name besides the key.
    """
    marked = oversample(images, instances, key, cls, targets, copies).where(F.col("split").isin(splits) | (F.col("copy_no") == 0))
    stem, ending = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    return marked.withColumn("output_name", F.when(F.col("copy_no") == 0, F.col("file_name")).otherwise(F.concat(stem, F.lit("_bal"), F.col("copy_no").cast("string"), ending)))


def counts_after(copies: DataFrame, instances: DataFrame, key: str, cls: str) -> DataFrame:
    """(split, class, instances) once every copy of an image counts with all its instances."""
    times = copies.groupBy("split", key).agg(F.count("*").alias("_times"))
    per = instances.groupBy(key, cls).agg(F.count("*").alias("_n"))
    return times.join(per, key).groupBy("split", cls).agg(F.sum(F.col("_times") * F.col("_n")).alias("instances"))
