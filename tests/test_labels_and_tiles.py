"""Label paths, zero-filled label counts, and tiles merged into images."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from granary.functions import geometry
from granary.operators import detections
from granary.sources import labels


def test_label_paths(spark):
    want = {"/d/train/images/a.jpg": "/d/train/labels/a.txt", "/d/images/x/images/b.tar.png": "/d/images/x/labels/b.tar.txt", "/d/Images/c.PNG": "/d/labels/c.txt", "/x/d/pics/e.v2.jpg": "/x/d/labels/e.v2.txt"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", labels.label_path(F.col("p"))).collect()} == want
    beside = {r[0]: r[1] for r in df.select("p", labels.label_path_beside(F.col("p"))).collect()}
    assert beside["/x/d/pics/e.v2.jpg"] == "/x/d/labels/e.v2.txt" and beside["/d/images/x/images/b.tar.png"] == "/d/images/x/labels/b.tar.txt"


def test_missing_label_files_count_as_zeros(spark):
    files = spark.createDataFrame([("a", "0 1 1\n2 1\nx 1\n9 1\n2.7 0\n"), ("b", ""), ("z", "0 1")], "k string, text string")
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {(r["k"], r["class_id"]): r["gt_count"] for r in labels.image_class_counts(images, files, "k", "text", 3).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("a", 2): 2, **{(k, c): 0 for k in "bc" for c in range(3)}}


def test_tiles_cover_the_image_and_overlap(spark):
    images = spark.createDataFrame([(k, w, h) for k, (w, h) in enumerate([(1000, 700), (640, 640), (100, 2000), (641, 640), (1300, 1300)])], "k int, w int, h int")
    at = {}
    for r in detections.tiles(images, "w", "h").collect():
        at.setdefault((r["k"], r["w"], r["h"]), []).append((r["x0"], r["y0"]))
    for (_, w, h), starts in at.items():
        covered = np.zeros((h, w), bool)
        for x, y in starts:
            assert 0 <= x <= max(0, w - 640) and 0 <= y <= max(0, h - 640)
            covered[y : y + 640, x : x + 640] = True
        assert covered.all() and len(set(starts)) == len(starts)


def test_merge_tiles(spark):
    schema = "image int, cls string, x1 double, y1 double, x2 double, y2 double, conf double"
    whole = spark.createDataFrame([(1, "Brick", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "nail", 700.0, 0.0, 710.0, 10.0, 0.5)], schema)
    tiled = spark.createDataFrame(
        [(1, "NAIL", 60.0, 0.0, 70.0, 10.0, 0.8, 640, 0), (1, "nail", 60.0, 0.0, 70.0, 10.0, 0.8, 640, 0), (1, "Brick", 50.0, 50.0, 60.0, 60.0, 0.9, 0, 0), (2, "Brick", 5.0, 5.0, 9.0, 9.0, 0.7, 0, 0), (2, "nail", 5.0, 5.0, 9.0, 9.0, 0.6, 0, 0)],
        schema + ", x0 int, y0 int",
    )
    got = Counter(tuple(r) for r in detections.merge_tiles(whole, tiled, "cls", ["nail"]).select("image", "cls", "x1", "conf").collect())
    # the tile's nail wins over the frame's weaker one; bricks of tiles count only where the image is one tile
    assert got == Counter([(1, "Brick", 0.0, 0.9), (1, "nail", 700.0, 0.8), (1, "NAIL", 700.0, 0.8), (2, "Brick", 5.0, 0.7), (2, "nail", 5.0, 0.6)])


def test_line_angles_and_clipped_points(spark):
    df = spark.createDataFrame([(a, v) for a, v in ((91.0, -3.2), (-90.0, 2.5), (90.0, 9.6), (-91.0, 3.5), (12.5, 0.0))], "a double, v double")
    got = df.select(geometry.line_angle(F.col("a")), geometry.clip(F.col("v"), F.lit(10))).collect()
    assert [tuple(r) for r in got] == [(-89.0, 0), (90.0, 2), (90.0, 9), (89.0, 4), (12.5, 0)]
