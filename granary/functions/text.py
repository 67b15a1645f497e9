"""Text shown in reports, and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points_text(points: Column) -> Column:
    """`(x, y); (x, y)`, empty for no points."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.lit("("), p["x"].cast("int").cast("string"), F.lit(", "), p["y"].cast("int").cast("string"), F.lit(")"))), "; ")


def breakdown_text(counts: Column) -> Column:
    """`Brick: 3 | nail: 1` from an array of (name, n), ordered without regard to case."""
    ordered = F.array_sort(F.transform(counts, lambda c: F.struct(F.lower(c["name"]).alias("k"), c["name"].alias("name"), c["n"].alias("n"))))
    shown = F.array_join(F.transform(ordered, lambda c: F.concat(c["name"], F.lit(": "), c["n"].cast("string"))), " | ")
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("No detected classes"))


def data_link(content: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def time_tag(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def quick_enough(elapsed_s: Column, size: Column) -> Column:
    return (elapsed_s < 1.0) & (size == 640)


def wrong_task(checkpoint: Column) -> Column:
    """Whether a checkpoint's name says that it was not trained for segmentation."""
    name = F.lower(checkpoint)
    return name.rlike("^(yolov8|yolo8|yolo11)") & ~F.contains(name, F.lit("-seg"))


def form_number(value: Column, default: float) -> Column:
    """A share given as text: no number gives the default, others are held within 0 and 1."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def form_size(value: Column) -> Column:
    asked = value.try_cast("int")
    return F.when(asked.isin(640, 1024), asked).otherwise(1024)
