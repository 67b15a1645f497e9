"""Reading and writing reports: metrics documents, training curves, count-error files, data links and split trees."""

from __future__ import annotations

import base64
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.schemas import COUNT_ERRORS

#: Levels of a metrics document that are unfolded; what lies deeper stays one leaf, as JSON.
DEPTH = 8


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """`metric_rows` of the metrics documents under `path`, each known by its file."""
    return metric_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.col("value").alias("content")))


def metric_rows(documents: DataFrame, document: str = "document", content: str = "content") -> DataFrame:
    """(document, path, parent, metric, value, text, corrupt): every leaf of JSON documents, whatever their keys.

    path joins the keys and places down to the leaf by dots, parent is the key above the last one (as `0:Brick` under
    `by_class`), metric the last. Numbers and truth values are in `value` too, all but null have a `text`. A document that is no JSON has one
    row without a path, whose text is its content; an empty object has none. Levels are unfolded one by one, so that
    a document of any size is spread over rows at its first level.
    """
    parsed = documents.select(F.col(document).alias("document"), F.col(content).alias("_content"), F.try_parse_json(content).alias("_v"))
    broken = parsed.where("_v IS NULL").select("document", F.lit(None).cast("array<string>").alias("_path"), F.col("_content").alias("text"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("corrupt"))
    level = parsed.where("_v IS NOT NULL").select("document", F.array().cast("array<string>").alias("_path"), "_v")
    kind = F.schema_of_variant("_v")
    inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    leaves = []
    for _ in range(DEPTH):
        own = level.where(~inner)
        number = F.coalesce(F.try_variant_get("_v", "$", "double"), F.try_variant_get("_v", "$", "boolean").cast("double"))
        leaves.append(own.select("document", "_path", F.try_variant_get("_v", "$", "string").alias("text"), F.when(kind != "STRING", number).alias("value"), F.lit(False).alias("corrupt")))
        level = documents.sparkSession.sql("SELECT d.document, concat(d._path, array(coalesce(e.key, CAST(e.pos AS STRING)))) AS _path, e.value AS _v FROM {d} d, LATERAL variant_explode(d._v) e", d=level.where(inner))
    deep = level.select("document", "_path", F.to_json("_v").alias("text"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("corrupt"))
    every = reduce(DataFrame.unionByName, [broken, *leaves, deep])
    return every.select("document", F.array_join("_path", ".").alias("path"), F.try_element_at("_path", F.lit(-2)).alias("parent"), F.try_element_at("_path", F.lit(-1)).alias("metric"), "value", "text", "corrupt")


def read_curves(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Training curves of several runs; columns that a run lacks are null."""
    each = []
    for run, path in paths.items():
        rows = spark.read.csv(path, header=True)
        each.append(rows.select(F.lit(run).alias("run"), *[F.col(f"`{c}`").try_cast("int" if c.strip() == "epoch" else "double").alias(c.strip()) for c in rows.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def json_safe(value):
    """Keys as text; numbers that JSON lacks as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, str | int | float | bool | type(None)) else str(value)


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def write_count_errors(rows: DataFrame, path: str, files: int | None = None) -> None:
    """The count-error table as CSV, in its fixed column order; total rows show `overall` as their class.

    `files` is the number of files, each written by one task: 1 for a report that is read as a whole.
    """
    shown = rows.withColumn("class_id", F.when(F.col("row_type") == "total", "overall").otherwise(F.col("class_id").cast("string"))).select(COUNT_ERRORS)
    (shown if files is None else shown.repartitionByRange(files, "image_path", "class_id").sortWithinPartitions("image_path", "class_id")).write.mode("overwrite").csv(path, header=True)


def csv_link(header: list[str], lines: list[list]) -> str:
    """A small table as a CSV data link with a byte-order mark; an empty one is an empty text."""
    import csv
    import io

    if not lines:
        return ""
    out = io.StringIO()
    csv.writer(out).writerows([header, *lines])
    return data_link(out.getvalue().encode("utf-8-sig"), "text/csv")


def data_link(data: bytes, kind: str) -> str:
    return f"data:{kind};base64,{base64.b64encode(data).decode()}"


def write_splits(samples: DataFrame, path: str, image: str = "image", labels: str = "labels", name: str = "output_name") -> None:
    """The split tree: folders of images and of labels by split, under their output names, and a manifest.

    samples: split, output_name (unique), the image's bytes and the label file's text; null contents give no row in that folder.
    All is written to a folder of its own beside `path`, whose manifest comes last; then it takes the place of `path`
    in one rename, the tree before it having moved aside. So a failed run leaves the old tree, a repeated one gives the
    same, and readers of `read_splits` never see a part.
    """
    spark = samples.sparkSession
    fs, at = _files(spark, path)
    fresh, old = at.suffix(f".{uuid.uuid4().hex}.new"), at.suffix(f".{uuid.uuid4().hex}.old")
    try:
        ending = F.regexp_extract(name, r"(\.[^.]*)?$", 0)
        stem = F.expr(f"substring(`{name}`, 1, length(`{name}`) - length(regexp_extract(`{name}`, '([.][^.]*)?$', 0)))")
        for kind, content, shown in (("images", image, F.col(name)), ("labels", labels, F.concat(stem, F.lit(".txt")))):
            rows = samples.where(F.col(content).isNotNull()).select("split", shown.alias("name"), F.col(content).alias("content"))
            rows.write.partitionBy("split").parquet(f"{fresh}/{kind}")
        manifest = samples.select("split", F.col(name).alias("name"), ending.alias("ending"), F.sha2(F.col(image), 256).alias("image_sha256"), F.sha2(F.coalesce(labels, F.lit("")), 256).alias("labels_sha256"))
        manifest.write.parquet(f"{fresh}/manifest")
        fs.mkdirs(at.getParent())
        moved = fs.exists(at)
        if moved and not fs.rename(at, old):
            raise OSError(f"can't move {path} aside")
        if not fs.rename(fresh, at):
            if moved:
                fs.rename(old, at)
            raise OSError(f"can't put the new tree in the place of {path}")
        fs.delete(old, True)
    finally:
        fs.delete(fresh, True)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, name, ending, image_sha256, labels_sha256, image, labels) of a split tree, by its manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    images = spark.read.parquet(f"{path}/images").select("split", "name", F.col("content").alias("image"))
    labels = spark.read.parquet(f"{path}/labels").select("split", F.col("name").alias("_label"), F.col("content").alias("labels"))
    label = F.concat(F.expr("substring(name, 1, length(name) - length(ending))"), F.lit(".txt"))
    return manifest.join(images, ["split", "name"], "left").withColumn("_label", label).join(labels, ["split", "_label"], "left").drop("_label")


def _files(spark: SparkSession, path: str):
    """The file system of a path, as Spark reaches it, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def visible_models(files: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(folder, name, rank): the first weights file of each known folder, in display order."""
    known = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    first = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    return files.withColumn("rank", known[F.col("folder")]).where("rank IS NOT NULL").withColumn("_n", first).where("_n = 1").drop("_n").orderBy("rank", F.lower("folder"))
