"""Counting errors: ground truth against predictions over the grid of images and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import latency


def _sums(images: DataFrame, instances: DataFrame, key: str, cls: str, classes: list, predicted: Column, true: Column | None) -> DataFrame:
    """(key, _times, _c0, _c1, ...): how many rows an image has in `images`, and its counts of each class.

    One sum over both tables' rows: a task holds some counts for each key, and neither side is sorted or joined.
    """
    true = F.lit(True) if true is None else true
    mine = [F.coalesce((F.col(cls) == c) & side, F.lit(False)).cast("long") for c in classes for side in (true, predicted)]
    flags = [f"_f{k}" for k in range(len(mine))]
    found = instances.where(F.col(key).isNotNull()).select(key, F.lit(0).cast("long").alias("_times"), *[m.alias(f) for m, f in zip(mine, flags, strict=True)])
    there = images.select(key, F.lit(1).cast("long").alias("_times"), *[F.lit(0).cast("long").alias(f) for f in flags])
    met = there.unionByName(found).groupBy(key).agg(F.sum("_times").alias("_times"), *[F.sum(f).alias(f) for f in flags]).where("_times > 0")
    return met.select(key, "_times", *[F.struct(F.col(f"_f{2 * k}").alias("gt"), F.col(f"_f{2 * k + 1}").alias("pred")).alias(f"_c{k}") for k in range(len(classes))])


def _cells(cls: str, classes: list) -> Column:
    return F.array(*[F.struct(F.lit(c).alias(cls), *[F.col(f"_c{k}.{side}").alias(f"{side}_count") for side in ("gt", "pred")]) for k, c in enumerate(classes)])


def count_grid(images: DataFrame, instances: DataFrame, key: str, cls: str, classes: list, predicted: Column, true: Column | None = None) -> DataFrame:
    """(key, class, gt_count, pred_count) for every image and class, zeros included.

    `predicted` and `true` (by default all) say which instances count on either side. Each image has one sum, a count for each of
    the fixed classes; the grid is exploded afterwards. An image that `images` repeats has its rows as often.
    """
    met = _sums(images, instances, key, cls, classes, predicted, true)
    return met.select(key, F.explode(F.flatten(F.array_repeat(_cells(cls, classes), F.col("_times").cast("int")))).alias("_e")).select(key, "_e.*")


def count_rows(images: DataFrame, instances: DataFrame, key: str, cls: str, classes: list, predicted: Column, true: Column | None = None) -> DataFrame:
    """(row_type, key, class, gt_count, pred_count and errors): the rows of `count_grid` and of `image_totals`, whose class is overall."""
    met = _sums(images, instances, key, cls, classes, predicted, true)
    named = lambda kind: lambda e: F.struct(F.lit(kind).alias("row_type"), e[cls].alias(cls), e["gt_count"].alias("gt_count"), e["pred_count"].alias("pred_count"))
    sums = {side: sum((F.col(f"_c{k}.{side}") for k in range(len(classes))), F.lit(0).cast("long")) * F.col("_times") for side in ("gt", "pred")}
    total = F.array(F.struct(F.lit("total").alias("row_type"), F.lit("overall").alias(cls), sums["gt"].alias("gt_count"), sums["pred"].alias("pred_count")))
    each = F.transform(F.flatten(F.array_repeat(_cells(cls, classes), F.col("_times").cast("int"))), named("class"))
    return with_errors(met.select(key, F.explode(F.concat(each, total)).alias("_e")).select("_e.row_type", key, f"_e.{cls}", "_e.gt_count", "_e.pred_count"))


def with_errors(counts: DataFrame) -> DataFrame:
    error = F.col("pred_count") - F.col("gt_count")
    return counts.withColumns({"error": error, "abs_error": F.abs(error), "squared_error": error * error, "exact": error == 0})


def image_totals(counts: DataFrame, key: str) -> DataFrame:
    return with_errors(counts.groupBy(key).agg(F.sum("gt_count").alias("gt_count"), F.sum("pred_count").alias("pred_count")))


def count_metric(errors: DataFrame, *by: str) -> DataFrame:
    """samples, totals, mean absolute and root mean square error, and share of exact counts; no rows give 0 and nulls."""
    zero = F.lit(0)
    return errors.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum("gt_count"), zero).alias("gt_total"),
        F.coalesce(F.sum("pred_count"), zero).alias("pred_total"),
        F.round(F.avg("abs_error"), 6).alias("mae"),
        F.round(F.sqrt(F.avg("squared_error")), 6).alias("rmse"),
        F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_accuracy"),
    )


def evaluation_rows(images: DataFrame, instances: DataFrame, classes: dict[int, str], predicted: Column, true: Column) -> DataFrame:
    """The rows of a count evaluation: one for each image and class, and one of totals for each image.

    images: (image, image_path, inference_ms, end_to_end_ms); an image without an inference time has the whole time
    there. instances: (image_path, class_id and what `predicted` and `true` ask for). Totals' class is -1, overall.
    """
    whole = F.col("end_to_end_ms").cast("double")
    told = images.select("image", "image_path", F.coalesce(F.col("inference_ms").cast("double"), whole).alias("inference_ms"), whole.alias("end_to_end_ms"))
    ids = sorted(classes)
    grid = count_grid(images, instances, "image_path", "class_id", ids, predicted, true)
    names = F.create_map(*[F.lit(x) for c in ids for x in (c, classes[c])])
    per = grid.groupBy("image_path").agg(F.collect_list(F.struct("class_id", "gt_count", "pred_count")).alias("c"))  # a row of the few classes
    total = lambda side: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x[f"{side}_count"])
    rows = F.transform("c", lambda x: F.struct(F.lit("class").alias("row_type"), x["class_id"].alias("class_id"), names[x["class_id"]].alias("class_name"), x["gt_count"].alias("gt_count"), x["pred_count"].alias("pred_count")))
    last = F.array(F.struct(F.lit("total").alias("row_type"), F.lit(-1).alias("class_id"), F.lit("overall").alias("class_name"), total("gt").alias("gt_count"), total("pred").alias("pred_count")))
    return with_errors(per.select("image_path", F.explode(F.concat(rows, last)).alias("r")).select("image_path", "r.*")).join(told, "image_path")


def evaluation_metrics(rows: DataFrame) -> DataFrame:
    """(part, class_id, metric, value) of `evaluation_rows`: by_class, overall, per_image_total and the two latencies.

    Counts are sums of one pass; percentiles come from a distributed order. Metrics without a row are null.
    """
    kinds = {"samples": F.count("*"), "gt_total": F.sum("gt_count"), "pred_total": F.sum("pred_count"), "mae": F.avg("abs_error"), "rmse": F.sqrt(F.avg("squared_error")), "exact_count_accuracy": F.avg(F.col("exact").cast("double"))}
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in kinds])).alias("m")
    part = lambda df, name, by: df.groupBy(*by).agg(*[a.alias(n) for n, a in kinds.items()]).select(F.lit(name).alias("part"), (F.col("class_id") if by else F.lit(None)).cast("int").alias("class_id"), long).select("part", "class_id", "m.*")
    single, totals = rows.where("row_type = 'class'"), rows.where("row_type = 'total'")
    out = part(single, "by_class", ["class_id"]).unionByName(part(single, "overall", [])).unionByName(part(totals, "per_image_total", []))
    for name in ("inference", "end_to_end"):
        told = latency.summary(totals, f"{name}_ms")
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in (("count", "n"), ("mean_ms", "mean"), ("median_ms", "median"), ("p95_ms", "p95"))])).alias("m")
        out = out.unionByName(told.select(F.lit(f"latency.{name}").alias("part"), F.lit(None).cast("int").alias("class_id"), each).select("part", "class_id", "m.*"))
    return out
