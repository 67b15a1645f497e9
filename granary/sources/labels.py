"""Label files: one instance per line, `class x1 y1 x2 y2 ...`, read by one of four rules.

    lenient  counts every line; the class is the first number, cut towards zero; ids outside 0 .. nc-1 are no class
    strict   a line needs seven tokens, an even number of coordinates and a class in range, else it has an error
    skip     lines whose class is no number or out of range are left out
    token    the first token as it stands
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number as it may stand in a label file; keeps suffixes such as 1d from being read as one.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def class_of(token: Column) -> Column:
    """`int(float(token))`: cut towards zero; null where the token is no number or is too large."""
    return F.when(token.rlike(NUMBER), token.try_cast("double").try_cast("int"))


def label_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, tokens) of the lines that are not blank."""
    lines = files.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)).alias("line_no", "raw"))
    lines = lines.withColumn("raw", F.btrim("raw", F.lit(" \t\x0b\x0c")))
    return lines.where("raw != ''").select(key, "line_no", F.split("raw", r"[ \t\x0B\f]+").alias("tokens"))


def parse_labels(files: DataFrame, key: str, text: str, classes: int, mode: str = "strict") -> DataFrame:
    """(key, line_no, class_token, class_id, polygon, error) by the rule `mode`; null texts have no lines."""
    token = F.col("tokens")[0]
    number = class_of(token)
    known = F.coalesce(number.between(0, classes - 1), F.lit(False))
    coordinates = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    numbers = F.transform(coordinates, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / 2 - 1).cast("int")), lambda k: F.struct(F.get(numbers, 2 * k).alias("x"), F.get(numbers, 2 * k + 1).alias("y")))
    error = (
        F.when(F.size("tokens") < 7, "fewer than three points")
        .when((F.size("tokens") - 1) % 2 != 0, "odd number of coordinates")
        .when(number.isNull(), "class is no number")
        .when(~known, "class out of range")
    )
    rows = label_lines(files, key, text).withColumns({"class_token": token, "class_id": number, "polygon": F.when(F.size("tokens") >= 3, points), "error": error if mode == "strict" else F.lit(None).cast("string")})
    if mode == "skip":
        rows = rows.where(known)
    elif mode == "lenient":
        rows = rows.withColumn("class_id", F.when(known, F.col("class_id")))
    elif mode == "token":
        rows = rows.withColumn("class_id", F.lit(None).cast("int"))
    return rows.drop("tokens")


def source_group(file_name: Column) -> Column:
    """The file name without its ending, up to the mark of an augmented copy, lower-cased."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.lower(F.element_at(F.split(stem, r"\.rf\.", 2), 1))


def label_path(image_path: Column) -> Column:
    """Path of the label file: the last `images` folder becomes `labels`, the ending becomes .txt.

    A path without such a folder leads to `labels` beside the image's folder.
    """
    swapped = F.regexp_replace(image_path, r"(?i)^(.*/)?images(/(?!(.*/)?images/).*)$", "$1labels$2")
    own = F.regexp_replace(swapped, r"\.[^./]*$", ".txt")
    return F.when(swapped != image_path, own).otherwise(label_path_beside(image_path))


def label_path_beside(image_path: Column) -> Column:
    """Path of the label file in the folder `labels` beside the image's folder."""
    return F.regexp_replace(image_path, r"^(.*/)?[^/]*/([^/]*?)(\.[^./]*)?$", "$1labels/$2.txt")


def image_class_counts(images: DataFrame, files: DataFrame, key: str, text: str, classes: int) -> DataFrame:
    """(key, class_id, gt_count) for every image and class: an image without a label file has zeros, lines whose class
    is no number or out of range count nowhere."""
    per = parse_labels(files, key, text, classes, "skip").groupBy(key).agg(*[F.count_if(F.col("class_id") == c).alias(f"_c{c}") for c in range(classes)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class_id"), F.coalesce(f"_c{c}", F.lit(0)).alias("gt_count")) for c in range(classes)])).alias("e")
    return images.select(key).join(per, key, "left").select(key, each).select(key, "e.*")
