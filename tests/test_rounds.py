"""Operators that work in rounds or over distributed orders, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import audit, components, counts, dedupe, detections, latency, ordered, samples, split
from granary.shared import Tables


@pytest.fixture
def small_batches(spark):
    """Many partitions, none of them merged, and batches that end inside runs."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def series(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3]) if i % 50 else i, i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, o int, v int").repartition(5)


def test_running_sums(spark, small_batches, series):
    tables = Tables(spark)
    got = ordered.running(series, ["k"], ["o"], {"c": None, "s": "v"}, tables).orderBy("k", "o").collect()
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    assert got == series.withColumns({"c": F.count("*").over(w), "s": F.coalesce(F.sum("v").over(w), F.lit(0))}).orderBy("k", "o").collect()
    places = ordered.running(series.drop("k"), [], ["o"], {"c": None}, tables).orderBy("o").collect()
    assert [r["c"] for r in places] == list(range(1, 3001))
    assert ordered.running(series.limit(0), ["k"], ["o"], {"c": None}, tables).collect() == []


@pytest.mark.parametrize("block", [8, 50, 10_000])
def test_rolling_blocks(spark, small_batches, series, block):
    got = ordered.rolling(series, ["k"], ["o"], 7, {"m": F.avg("v"), "n": F.count("*")}, Tables(spark), block=block).orderBy("k", "o").collect()
    w = Window.partitionBy("k").orderBy("o").rowsBetween(-6, 0)
    assert got == series.withColumns({"m": F.avg("v").over(w), "n": F.count("*").over(w)}).orderBy("k", "o").collect()


def test_percentiles(spark, small_batches, series):
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for keys in (["k"], []):
        got = ordered.percentiles(series, keys, "v", shares, Tables(spark)).orderBy(*keys or ["n"]).collect()
        want = series.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *[F.percentile("v", q).alias(n) for n, q in shares.items()]).orderBy(*keys or ["n"]).collect()
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert tuple(a) == pytest.approx(tuple(b)) if b["mean"] is not None else tuple(a) == tuple(b)
    assert latency.summary(series.limit(0), "v", "k").count() == 0


def clusters(pixels):
    left, out = set(pixels), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            x, y = todo.pop()
            own.append((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(own)
    return out


def table(spark, pixels):
    return spark.createDataFrame([(k, x, y) for k, own in pixels.items() for x, y in own] + [(1, None, 3)], "i int, x int, y int")


SPIRAL = [(x, 0) for x in range(20)] + [(19, y) for y in range(20)] + [(x, 19) for x in range(3, 20)] + [(3, y) for y in range(4, 20)] + [(x, 4) for x in range(3, 15)] + [(14, y) for y in range(4, 14)]
RNG = random.Random(3)
MASKS = {1: SPIRAL + [(8, 8), (9, 9), (8, 10)], 2: [(x, y) for x in range(40) for y in range(40) if RNG.random() < 0.4], 3: [(0, 0)], 4: [(x, y) for x in range(30) for y in range(30) if x % 2 == 0], None: [(5, 5), (6, 6), (5, 5)]}


def test_components(spark):
    rows = components.component_table(table(spark, MASKS), "i").collect()
    want = []
    for k, pixels in MASKS.items():
        for own in clusters(pixels):
            top = min((y, x) for x, y in own)
            xs, ys = [p[0] for p in own], [p[1] for p in own]
            want.append((k, *top, len(own), round(sum(xs) / len(own)), round(sum(ys) / len(own)), min(xs), max(xs), max(ys)))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert components.component_table(table(spark, {}), "i").count() == 0


def test_largest_component(spark):
    got = {}
    for r in components.largest_component(table(spark, MASKS), "i").collect():
        got.setdefault(r["i"], set()).add((r["x"], r["y"]))
    for k, pixels in MASKS.items():
        assert got[k] == set(min(clusters(pixels), key=lambda own: (-len(own), min((y, x) for x, y in own))))


@pytest.mark.parametrize("side", [1, 4, 7])
def test_components_across_tiles(spark, monkeypatch, side):
    """Masks of many tiles, with places below 0 too, and tiles that end in other batches."""
    monkeypatch.setattr(components.pixel_tiles, "SIDE", side)
    masks = {k: [(x - 9, y - 5) for x, y in own] for k, own in MASKS.items() if k != 4}
    got = {(r["i"], r["top_y"], r["top_x"], r["pixels"]) for r in components.component_table(table(spark, masks), "i").collect()}
    assert got == {(k, *min((y, x) for x, y in own), len(own)) for k, pixels in masks.items() for own in clusters(pixels)}
    for r in components.degrees(table(spark, masks), "i").where("x IS NOT NULL").collect():
        own = set(masks[r["i"]])
        assert r["degree"] == sum((r["x"] + a, r["y"] + b) in own for a in (-1, 0, 1) for b in (-1, 0, 1)) - 1


def test_components_of_small_masks_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "connected", lambda *a: pytest.fail("rounds for masks of one tile"))
    masks = {k: [(x, y) for x, y in own] for k, own in MASKS.items()}
    assert components.component_table(table(spark, masks), "i").count() == sum(len(clusters(own)) for own in masks.values())


def test_ends_and_branches(spark):
    """A cross: four ends, and its five middle pixels are one branch."""
    cross = {1: [(x, 5) for x in range(11)] + [(5, y) for y in range(11)]}
    rows = {(r["kind"], r["x"], r["y"], r["pixels"]) for r in components.ends_and_branches(table(spark, cross), "i").collect()}
    assert rows == {("end", 0, 5, 1), ("end", 10, 5, 1), ("end", 5, 0, 1), ("end", 5, 10, 1), ("branch", 5, 5, 5)}


def boxes(seed, n):
    rng, rows = random.Random(seed), []
    for k in range(n):
        x, y = rng.random() * 120 - 20, rng.random() * 120
        w, h = (rng.choice([1, 5, 20, 60]) * (0.5 + rng.random()) for _ in range(2))
        rows.append((rng.choice(["a", "a", None]), x, y, x + w, y + h, rng.choice([rng.random(), 0.5]), k))
    rows += [(*r[:6], 1000 + k) for k, r in enumerate(rows[:30])]
    return rows + [("a", 1.0, 1.0, 1.0, 1.0, 0.9, 1), ("a", 5.0, 5.0, 0.0, 0.0, 0.9, 1), ("a", float("inf"), 1.0, 2.0, 2.0, 0.9, 1)]


@pytest.mark.parametrize("iou,most,leaders", [(0.3, 40, 4), (0.7, 100, 64), (0.3, 10_000, 64)])
def test_nms_rounds(spark, iou, most, leaders):
    rows = boxes(int(iou * 10), 500)
    want = Counter()
    for k in ("a", None):
        own = [r for r in rows if r[0] == k]
        own.sort(key=lambda r: (-r[5], r[1:5]))
        kept = detections.suppress(np.array([r[1:5] for r in own]), np.array([r[5] for r in own]), iou)
        want.update(own[j][:6] for j in kept)
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, conf double, n int")
    for found in (detections.nms_rounds(df, ["k"], iou, most, leaders), detections.class_nms(df, ["k"], iou, most)):
        assert Counter(tuple(r)[:6] for r in found.collect()) == want


def test_kept_boxes_overlap_little(spark):
    df = spark.createDataFrame(boxes(5, 300), "k string, x1 double, y1 double, x2 double, y2 double, conf double, n int").where("x2 > x1 AND x1 < 1000")
    kept = detections.class_nms(df, ["k"], 0.3, most=50)
    pairs = kept.alias("a").join(kept.alias("b"), (F.col("a.k").eqNullSafe(F.col("b.k"))) & (F.col("a.n") < F.col("b.n")))
    assert pairs.select(detections.overlap("a", "b").alias("o")).agg(F.max("o")).first()[0] <= 0.3


def test_nms_rounds_store_few_rows(spark, monkeypatch):
    """What the rounds store stays near the boxes' number, however many cells and pairs they have."""
    rng, stored, write = random.Random(9), [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df: (table := write(self, df), stored.append(table.count()))[0])
    at = [(rng.randrange(200), rng.randrange(200), rng.randrange(1, 51)) for _ in range(600)]
    df = spark.createDataFrame([("a", float(x), float(y), float(x + s), float(y + s), rng.randrange(11) / 10) for x, y, s in at], "k string, x1 double, y1 double, x2 double, y2 double, conf double")
    detections.nms_rounds(df, ["k"], 0.3, 256)
    assert sum(stored) < 5 * 600


def test_nms_rounds_see_boxes_of_any_size(spark):
    rows = [("a", 0.0, 0.0, 5000.0, 5000.0, 0.9)] + [("a", 10.0 * k, 7.0, 10.0 * k + 1, 8.0, 0.5) for k in range(50)]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert [r["conf"] for r in detections.nms_rounds(df, ["k"], 0.0, 4).collect()] == [0.9]


def test_settle_holds_back_what_waits_for_other_tiles():
    """Of four boxes in a row, each over the next, the first is in other tiles too: nothing is certain but that it is free here."""
    boxes_ = np.array([[0.0, 0.0, 10.0, 10.0], [3.0, 0.0, 13.0, 10.0], [6.0, 0.0, 16.0, 10.0], [9.0, 0.0, 19.0, 10.0]]).T
    none, alone = np.zeros(4, bool), np.array([False, True, True, True])
    assert detections.settle(boxes_, none, alone, 64, 0.3)[0].tolist() == [detections.FREE, detections.OPEN, detections.OPEN, detections.OPEN]
    assert detections.settle(boxes_, none, ~none, 64, 0.3)[0].tolist() == [detections.FREE, detections.GONE, detections.FREE, detections.GONE]
    assert detections.settle(boxes_, none, ~none, 1, 0.3)[0].tolist() == [detections.FREE, detections.GONE, detections.OPEN, detections.OPEN]


def test_count_rows_repeat_with_their_image(spark):
    images = spark.createDataFrame([(1,), (1,), (2,), (None,)], "image int")
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, None, 1), (3, "a", 1), (None, "a", 1)], "image int, cls string, p int")
    asked = (images, found, "image", "cls", ["a", "b"], F.col("p") == 1)
    grid = counts.with_errors(counts.count_grid(*asked))
    total = counts.image_totals(grid, "image").withColumns({"row_type": F.lit("total"), "cls": F.lit("overall")})
    want = grid.withColumn("row_type", F.lit("class")).unionByName(total)
    got = counts.count_rows(*asked)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect()))
    assert Counter((r["image"], r["cls"], r["gt_count"], r["pred_count"]) for r in grid.collect()) == Counter([(1, "a", 1, 1), (1, "b", 1, 0)] * 2 + [(i, c, 0, 0) for i in (2, None) for c in "ab"])
    assert "Join" not in got._jdf.queryExecution().toString() and "Sort" not in got._jdf.queryExecution().toString()


def test_missing_names_take_one_sum(spark):
    images = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    files = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k int")
    got = audit.missing_names(images, files, "k")
    assert Counter(map(tuple, got.collect())) == Counter([("label", 1), ("label", 1), ("label", None), ("image", 3), ("image", 3), ("image", None)])
    assert "Join" not in got._jdf.queryExecution().toString()


def named(rows):
    """The sequence that names are given in, one sample after the other."""
    used, out = set(), []
    for _, name, digest in sorted(rows):
        dot = name.rfind(".")
        stem, ending = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
        new, k = name, 0
        while new in used:
            new = f"{stem}_{digest[:10]}" + (f"_{k}" if k else "") + ending.lower()
            k += 1
        used.add(new)
        out.append(new)
    return out


H, G = "0123456789abcdef", "fedcba9876543210"
NAMES = [
    [("a.JPG", H), ("a.JPG", H), ("a.jpg", H), ("a.jpg", H)],
    [("b.png", H), ("b.png", H), ("b.png", H), (f"b_{H[:10]}_1.png", G), (f"b_{H[:10]}.png", G)],
    [(f"b_{H[:10]}_1.png", G), (f"b_{H[:10]}.png", G), ("b.png", H), ("b.png", H), ("b.png", H), (f"b_{H[:10]}_3.png", G), (f"b_{H[:10]}_3.png", G), ("b.png", H), ("b.png", H)],
    [("c", H), ("c", G), ("c", H), (".hidden", H), (".hidden", H), ("x.tar.gz", G), ("x.tar.gz", G)],
    [("d.png", H)] * 40 + [(f"d_{H[:10]}_{k}.png", G) for k in (3, 5, 50)] + [("d.png", H)] * 20 + [("d.PNG", H)] * 5,
]


@pytest.mark.parametrize("case", range(len(NAMES) + 2))
def test_output_names(spark, case):
    rng = random.Random(case)
    rows = NAMES[case] if case < len(NAMES) else [(rng.choice(["e.jpg", "e.JPG", f"e_{H[:10]}.jpg", f"e_{H[:10]}_1.jpg", f"e_{H[:10]}_2.jpg", f"e_{G[:10]}.JPG", "f"]), rng.choice([H, G])) for _ in range(60)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "n int, name string, digest string").repartition(3)
    got = [r["output_name"] for r in dedupe.output_names(df, "name", "digest", ["n"]).orderBy("n").collect()]
    assert got == named(rows) and len(set(got)) == len(got)


def test_missing_label_file_stops_any_action(spark):
    images = spark.createDataFrame([(1, "p1"), (2, "p2")], "k int, path string")
    files = spark.createDataFrame([(1, "x")], "k int, text string")
    joined = samples.collect_samples(images, files, "k", "path")
    for act in (joined.count, joined.select("k", "text").collect, joined.agg(F.sum("k")).collect):
        with pytest.raises(Exception, match="no label file for p2"):
            act()
    assert samples.collect_samples(images.where("k = 1"), files, "k", "path").collect()[0].asDict() == {"k": 1, "path": "p1", "text": "x"}


@pytest.mark.parametrize("large", [1000, 4, 1])
def test_split_search(spark, large):
    rng = random.Random(large)
    rows = [(g if g else None, g * 100 + i, rng.choice(["a", "b", "b", "rare" if g % 7 == 0 else "a", None])) for g in range(40) for i in range(rng.choice([1, 2, 3, 10, 25]))]
    df = spark.createDataFrame(rows, "g int, image int, cls string")
    found = split.search(df, "g", "image", "cls", trials=60, large=large)
    to = {r["g"]: r["split"] for r in found.collect()}
    (best,) = {r["score"] for r in found.collect()}
    assert set(to) == {r[0] for r in rows} and found.count() == len(to)
    dealt = spark.createDataFrame([(to[g], i, c) for g, i, c in rows], "split string, image int, cls string")
    assert split.ratio_score(dealt, "split", "image", "cls").first()[0] == pytest.approx(best, abs=1e-5)
    more = split.search(df, "g", "image", "cls", trials=120, large=large).first()["score"]
    assert more <= best
    assert split.search(df.limit(0), "g", "image", "cls", trials=3).count() == 0
