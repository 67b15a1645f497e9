"""Sources and sinks round trip, evaluation identities, distances by brute force, and streams with late rows."""

import datetime
import json
import math
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import counts, distance, skeleton
from granary.schemas import COUNT_ERRORS
from granary.sources import images, reports
from granary.streaming import latency as streams
from granary.operators import latency


def test_stream_with_late_rows(spark, tmp_path):
    """Files arrive out of order; every row within the delay comes out once, in event order, as the batch has it."""
    rng, start = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + datetime.timedelta(seconds=30 * (k // 2)), k, rng.random()) for k in range(240)]
    rows.sort(key=lambda r: r[1].timestamp() + rng.random() * 400)  # up to seven minutes late
    schema = "k string, at timestamp, n long, v double"
    parts = [rows[k : k + 40] for k in range(0, 240, 40)]
    flush = [[(k, start + datetime.timedelta(hours=h), 10_000 + 10 * h + i, 1.0) for i, k in enumerate("ab")] for h in (9, 19)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in [*parts, *flush]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.rolling_stream(spark.readStream.schema(schema).parquet(source), "k", "at", "n", "v")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["n"]: r for r in spark.read.parquet(out).where("n < 10000").collect()}
    want = latency.rolling(spark.createDataFrame(rows, schema), "v", ["k"], ["at", "n"]).collect()
    assert set(got) == {r["n"] for r in want} and spark.read.parquet(out).where("n < 10000").count() == len(want)
    for r in want:
        assert got[r["n"]]["at"] == r["at"] and got[r["n"]]["rolling_mean"] == pytest.approx(r["rolling_mean"], abs=1e-6)
        assert (r["rolling_p95"] is None and (got[r["n"]]["rolling_p95"] is None or math.isnan(got[r["n"]]["rolling_p95"]))) or got[r["n"]]["rolling_p95"] == pytest.approx(r["rolling_p95"], abs=1e-6)


SAMPLES = [("train", "a.jpg", b"\x01", "0 1 1 1 1"), ("val", "b.tar.png", b"\x02\x03", ""), ("test", "noending", b"", "1 0 0 0 0"), ("test", "ü.jpg", None, "x"), ("test", "c.jpg", b"\x05", None)]


def tree(spark, path):
    return {(r["split"], r["name"], None if r["image"] is None else bytes(r["image"]), r["labels"]) for r in reports.read_splits(spark, path).collect()}


def test_split_tree_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "deep" / "tree")
    df = spark.createDataFrame(SAMPLES, "split string, output_name string, image binary, labels string")
    for _ in range(2):
        reports.write_splits(df, path)
        assert tree(spark, path) == {(*s,) for s in SAMPLES}
    with pytest.raises(Exception, match="no more"):  # fails in the midst of the run
        reports.write_splits(df.withColumn("labels", F.when(F.col("output_name") == "c.jpg", F.raise_error(F.lit("no more"))).otherwise(F.lit("new"))), path)
    assert tree(spark, path) == {(*s,) for s in SAMPLES}
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["tree"]  # nothing is left beside it
    reports.write_splits(df.where("split = 'val'"), path)
    assert tree(spark, path) == {(*SAMPLES[1],)}


@pytest.fixture(scope="module")
def evaluation(spark):
    rng = random.Random(6)
    pictures = [(f"i{k}.jpg", f"/d/i{k}.jpg", rng.choice([None, 10.0 + k]), 20.0 + k) for k in range(30)]
    found = [(f"/d/i{rng.randrange(28)}.jpg", rng.choice([0, 1, 1, 2, 7]), rng.random() < 0.6, rng.random() < 0.7) for _ in range(300)]
    rows = counts.evaluation_rows(spark.createDataFrame(pictures, "image string, image_path string, inference_ms double, end_to_end_ms double"), spark.createDataFrame(found, "image_path string, class_id int, p boolean, t boolean"), {0: "Brick", 1: "I-beam", 2: "nail"}, F.col("p"), F.col("t"))
    return pictures, found, rows.persist()


def test_evaluation_identities(spark, evaluation):
    pictures, found, rows = evaluation
    value = {(r["part"], r["class_id"], r["metric"]): r["value"] for r in counts.evaluation_metrics(rows).collect()}
    of = lambda part, m, c=None: value[part, c, m]
    assert of("overall", "samples") == 3 * len(pictures) == sum(of("by_class", "samples", c) for c in range(3))
    assert of("per_image_total", "samples") == len(pictures) == of("latency.inference", "count") == of("latency.end_to_end", "count")
    for m in ("gt_total", "pred_total"):
        assert of("overall", m) == of("per_image_total", m) == sum(of("by_class", m, c) for c in range(3))
    assert of("overall", "gt_total") == sum(t for _, c, _, t in found if c < 3)
    for part, c in (("by_class", 0), ("overall", None), ("per_image_total", None)):
        assert of(part, "rmse", c) >= of(part, "mae", c) >= 0 and 0 <= of(part, "exact_count_accuracy", c) <= 1
    assert of("overall", "mae") == pytest.approx(sum(of("by_class", "mae", c) for c in range(3)) / 3)
    assert of("latency.end_to_end", "median_ms") == pytest.approx(34.5) and of("latency.inference", "p95_ms") <= of("latency.end_to_end", "p95_ms")
    empty = counts.evaluation_metrics(rows.limit(0)).where("part = 'overall'").collect()
    assert {r["metric"]: r["value"] for r in empty}["samples"] == 0 and {r["metric"]: r["value"] for r in empty}["mae"] is None


def test_count_error_file(spark, evaluation, tmp_path):
    pictures, _, rows = evaluation
    reports.write_count_errors(rows, str(tmp_path / "csv"), files=1)
    (part,) = (tmp_path / "csv").glob("*.csv")
    lines = part.read_text().splitlines()
    assert lines[0].split(",") == COUNT_ERRORS and len(lines) == 1 + 4 * len(pictures)
    assert sum(x.startswith("total,") and ",overall,overall," in x for x in lines) == len(pictures)


def test_metrics_documents(spark, tmp_path):
    doc = {"split": "test", "map": {"box": {"mp": 0.84, "per_class": [0.28, 0.87]}, "speed": {}}, "counts": {"by_class": {"0:Brick": {"samples": 66, "mae": 7.8, "rmse": None}}}, "deep": {str(k): k for k in range(3)}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("{not json")
    rows = reports.read_metrics(spark, str(tmp_path)).collect()
    by = {r["path"]: r for r in rows if not r["corrupt"]}
    assert set(by) == {"split", "map.box.mp", "map.box.per_class.0", "map.box.per_class.1", "counts.by_class.0:Brick.samples", "counts.by_class.0:Brick.mae", "counts.by_class.0:Brick.rmse", "deep.0", "deep.1", "deep.2"}
    brick = by["counts.by_class.0:Brick.samples"]
    assert (brick["parent"], brick["metric"], brick["value"]) == ("0:Brick", "samples", 66.0) and brick["document"].endswith("a.json")
    assert by["counts.by_class.0:Brick.rmse"]["value"] is None and by["split"]["text"] == "test" and by["split"]["value"] is None
    (bad,) = [r for r in rows if r["corrupt"]]
    assert bad["text"] == "{not json" and bad["path"] is None and bad["document"].endswith("b.json")


def test_distances_by_brute_force(spark):
    rng = random.Random(1)
    masks = {1: [(x, y) for x in range(30) for y in range(20)], 2: [(x, y) for x in range(25) for y in range(25) if rng.random() < 0.85], 3: [(4, 4)], None: [(-x, y) for x in range(9) for y in range(9) if x + y > 3]}
    rows = [(k, x, y) for k, own in masks.items() for x, y in own]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # runs go over batches
    got = {(r["i"], r["x"], r["y"]): r["d2"] for r in distance.distance_transform(spark.createDataFrame([*rows, *rows[:9]], "i int, x int, y int"), "i").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k, own in masks.items():
        own = set(own)
        around = {(x + a, y + b) for x, y in own for a in (-1, 0, 1) for b in (-1, 0, 1)} - own
        for x, y in own:
            want[k, x, y] = min((x - a) ** 2 + (y - b) ** 2 for a, b in around)
    assert got == want


def test_ridge_runs_along_the_middle(spark):
    bar = spark.createDataFrame([(1, x, y) for x in range(60) for y in range(7)], "i int, x int, y int")
    ridge = {(r["x"], r["y"]): r["d2"] for r in distance.ridge(bar, "i").collect()}
    assert {(x, 3) for x in range(4, 56)} <= set(ridge) and all(ridge[x, 3] == 16 for x in range(4, 56))
    assert all(y == 3 for x, y in ridge if 6 < x < 53)


def test_nail_from_its_mask(spark):
    """A nail along x with its head at the left, and a speck: angle, tip and head come from the mask alone."""
    nail = [(x, y) for x in range(10, 90) for y in range(18, 23)] + [(x, y) for x in range(4, 10) for y in range(8, 33)] + [(200, 200)]
    largest, ridge = distance.nail_masks(spark.createDataFrame([(1, x, y) for x, y in nail], "i int, x int, y int"), "i")
    r = skeleton.t_profile(largest, "i", skeleton=ridge).first()
    assert r["status"] == "ok_t_profile_skeleton" and abs(r["angle_deg"]) < 3 and abs(r["tip_x"] - 89) <= 2 and r["head_x"] < 15 and abs(r["head_y"] - 20) <= 2
    assert {r["cap_y1"] < 20, r["cap_y2"] < 20} == {True, False}


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\0" * 5


def jpeg(w, h):
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08" + struct.pack(">HH", h, w) + b"\0" * 6


def test_image_listings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.JPG": jpeg(40, 30), "b.png": png(7, 5), "c.txt": b"no image", "bad.bmp": b"BM", "g.webp": b"", "sub/d.tiff": b"x", "sub/e.gif": b"GIF89a" + struct.pack("<HH", 3, 4)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    flat = images.list_images(spark, str(tmp_path)).withColumn("size", images.image_size_of("content"))
    assert {(r["file_name"], r["size"]) for r in flat.collect()} == {("a.JPG", "40x30"), ("b.png", "7x5"), ("bad.bmp", "unreadable")}
    deep = {r["file_name"] for r in images.list_images(spark, str(tmp_path), recursive=True).collect()}
    assert deep == {"a.JPG", "b.png", "bad.bmp", "d.tiff"}
    (tmp_path / "list.txt").write_text("/x/a.jpg\n /x/a.jpg \n/x/b.mpo\n/x/readme.md\n\n")
    assert sorted(r["path"] for r in images.read_manifest(spark, str(tmp_path / "list.txt")).collect()) == ["/x/a.jpg", "/x/b.mpo"]


def test_training_curves(spark, tmp_path):
    (tmp_path / "one.csv").write_text("epoch, train/loss,val\n1, 0.5,0.1\n2, x,0.2\n")
    (tmp_path / "two.csv").write_text("epoch,other\n1,9\n")
    rows = reports.read_curves(spark, {"one": str(tmp_path / "one.csv"), "two": str(tmp_path / "two.csv")}).orderBy("run", "epoch").collect()
    assert [r.asDict() for r in rows] == [{"run": "one", "epoch": 1, "train/loss": 0.5, "val": 0.1, "other": None}, {"run": "one", "epoch": 2, "train/loss": None, "val": 0.2, "other": None}, {"run": "two", "epoch": 1, "train/loss": None, "val": None, "other": 9.0}]


def test_form_values_and_tags(spark):
    row = spark.createDataFrame([Row(at=datetime.datetime(2024, 5, 6, 7, 8, 9), a="0.7", b="x", c="7", s="640", t="641", w="YOLOv8x.pt", g="yolov8x-seg.pt", e=0.5, z=640)]).select(
        text.time_tag(F.col("at")), text.form_number(F.col("a"), 0.2), text.form_number(F.col("b"), 0.2), text.form_number(F.col("c"), 0.2), text.form_size(F.col("s")), text.form_size(F.col("t")), text.wrong_task(F.col("w")), text.wrong_task(F.col("g")), text.quick_enough(F.col("e"), F.col("z")), text.data_link(F.lit(b"ab"), "x/y")
    )
    assert tuple(row.first()) == ("20240506_070809", 0.7, 0.2, 1.0, 640, 1024, True, False, True, "data:x/y;base64,YWI=")


def test_json_safe_and_links():
    assert reports.json_safe({1: float("nan"), "a": [float("inf"), 2, {"b": (1,)}]}) == {"1": None, "a": [None, 2, {"b": [1]}]}
    assert reports.csv_link(["a"], []) == "" and reports.csv_link(["a"], [[1]]).startswith("data:text/csv;base64,77u/")
