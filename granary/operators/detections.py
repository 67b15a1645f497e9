"""Detections: confidence floors, counts, numbering, tiles and non-maximum suppression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.geometry import tile_starts
from granary.operators.ordered import changes
from granary.shared import Tables

#: Boxes of one image and class that a task settles at once; more are settled in rounds, by place.
GROUP = 4096


def confident(conf: Column, cls: Column, floors: dict[str, float], otherwise: float) -> Column:
    """Whether a detection reaches its class's floor; class names compare without regard to case."""
    floor = F.lit(otherwise)
    for name, value in floors.items():
        floor = F.when(F.lower(cls) == name.lower(), value).otherwise(floor)
    return conf >= floor


def confidence_stats(detections: DataFrame, cls: str, conf: str) -> DataFrame:
    return detections.groupBy(cls).agg(F.round(F.avg(conf), 3).alias("mean_conf"), F.round(F.min(conf), 3).alias("min_conf"), F.round(F.max(conf), 3).alias("max_conf"))


def counts_raw_and_effective(detections: DataFrame, key: str, cls: str, area: str, least: float) -> DataFrame:
    """(key, class, raw_count, effective_count): all detections, and those whose mask is large enough."""
    return detections.groupBy(key, F.coalesce(cls, F.lit("unknown")).alias(cls)).agg(F.count("*").alias("raw_count"), F.count_if(F.col(area) >= least).alias("effective_count"))


def low_confidence_retry(detections: DataFrame, key: str, cls: str, conf: str, target: str, user: float, floor: float, tiled: Column | None = None, above: float = 0.10) -> DataFrame:
    """Detections at `user` confidence; images that have no `target` there take theirs at `floor` as well.

    There is no second look where the user asks for `above` or less, nor at images that are `tiled`.
    """
    at_user = F.lower(cls) == target.lower()
    has = detections.groupBy(key).agg(F.bool_or(at_user & (F.col(conf) >= user)).alias("_has"))
    marked = detections.join(has, key)
    again = ~F.col("_has") & F.lit(user > above) & ~(F.lit(False) if tiled is None else tiled)
    keep = (F.col(conf) >= user) | (again & at_user & (F.col(conf) >= floor))
    return marked.where(keep).withColumn("retried", again).drop("_has")


def number_instances(detections: DataFrame, key: str, cls: str, order: list[str], first: str, without: list[str]) -> DataFrame:
    """Adds instance_id per image: class `first` before others, then by `order`; classes in `without` get none."""
    numbered = detections.where(~F.lower(cls).isin([x.lower() for x in without]))
    w = Window.partitionBy(key).orderBy((F.lower(cls) != first.lower()).cast("int"), *order)
    return numbered.withColumn("instance_id", F.row_number().over(w))


def palette_index(detections: DataFrame, key: str, order: list[str], colours: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return detections.withColumn("colour", (F.row_number().over(w) - 1) % colours)


def tiles(images: DataFrame, width: str, height: str, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """Adds x0 and y0 of each tile of an image, row by row."""
    return images.withColumn("y0", F.explode(tile_starts(F.col(height), tile, overlap))).withColumn("x0", F.explode(tile_starts(F.col(width), tile, overlap)))


def to_image(detections: DataFrame) -> DataFrame:
    """Boxes of a tile, moved to the image: x0 and y0 are added."""
    for axis in ("x", "y"):
        for k in (1, 2):
            detections = detections.withColumn(f"{axis}{k}", F.col(f"{axis}{k}") + F.col(f"{axis}0"))
    return detections


def merge_tiles(whole: DataFrame, tiled: DataFrame, cls: str, allowed: list[str], key: str = "image", iou: float = 0.3) -> DataFrame:
    """Full-frame detections of all classes with tile detections of the allowed ones, without what overlaps in a class.

    `tiled` has the tile's corner (x0, y0); an image of one tile has no full frame, and its detections of all classes count.
    """
    single = tiled.groupBy(key).agg((F.count_distinct("x0", "y0") == 1).alias("_one"))
    framed = whole.select(F.col(key).alias("_framed")).distinct()
    told = tiled.join(single, key).join(framed, F.col(key) == F.col("_framed"), "left")
    kept = told.where(F.lower(cls).isin([a.lower() for a in allowed]) | (F.col("_one") & F.col("_framed").isNull()))
    both = whole.unionByName(to_image(kept).drop("_one", "_framed", "x0", "y0"), allowMissingColumns=True)
    return class_nms(both, [key, cls], iou)


def suppress(boxes: np.ndarray, conf: np.ndarray, iou: float) -> np.ndarray:
    """Indices kept, most confident first: each drops later boxes that overlap it by more than `iou`."""
    order = np.lexsort((np.arange(len(conf)), -conf))
    area = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    kept = []
    while len(order):
        top, rest = order[0], order[1:]
        kept.append(top)
        low, high = np.maximum(boxes[top, :2], boxes[rest, :2]), np.minimum(boxes[top, 2:], boxes[rest, 2:])
        both = np.prod(np.maximum(0, high - low), axis=1)
        order = rest[both <= iou * np.maximum(area[top] + area[rest] - both, 1e-12)]
    return np.array(kept, np.int64)


def class_nms(detections: DataFrame, keys: list[str], iou: float = 0.3, most: int = GROUP) -> DataFrame:
    """Non-maximum suppression of (x1, y1, x2, y2, conf) within `keys`, usually image and class.

    Rows of equal confidence go by box. Groups of up to `most` boxes are small and many: sorted partitions are
    streamed and each run of equal keys is handled as it ends. Larger ones are settled in rounds (`nms_rounds`).
    """
    own = [f"_key{i}" for i in range(len(keys))]
    large = detections.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)])
    tables = Tables(detections.sparkSession)
    large = tables.write(large)
    if not large.head(1):
        tables.drop(large)
        return _streamed(detections, keys, iou)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)])
    few = _streamed(detections.join(large, same, "left_anti"), keys, iou)
    return few.unionByName(nms_rounds(detections.join(large, same, "left_semi"), keys, iou, most))


def _streamed(detections: DataFrame, keys: list[str], iou: float) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf[keys].ne(pdf[keys].shift()) & ~(pdf[keys].isna() & pdf[keys].shift().isna())).any(axis=1).to_numpy()
            new[:1] = True  # a frame begins with a group, with one of null keys too
            new = np.flatnonzero(new)
            rest = pdf.iloc[new[-1] :] if len(new) else None
            yield pdf.iloc[_kept(pdf, new, iou)]
        if rest is not None:
            yield rest.iloc[_kept(rest, np.array([0, len(rest)]), iou)]

    order = [*keys, F.desc("conf"), "x1", "y1", "x2", "y2"]
    return detections.repartition(*keys).sortWithinPartitions(*order).mapInPandas(run, detections.schema)


def _tiles(boxes: DataFrame, iou: float) -> DataFrame:
    """A row for each tile in which a box can meet one that it overlaps by more than `iou`; `_tiles` is their number.

    Overlapping by more than a share, boxes differ in size by less than its inverse. Tiles of a grid are at least twice
    as large as its boxes, grids are a factor of 16 apart, and a box looks into its own grid and into those of the
    larger boxes in reach: into one tile mostly, and four of a grid at most.
    """
    # what is no box is filtered out, but perhaps later than it is looked at here: bounds keep its tiles few
    within = lambda v, least: F.least(F.greatest(v, F.lit(least)), F.lit(2e15))
    side = {c: within(F.col(c).cast("double"), -1e15) for c in ("x1", "y1", "x2", "y2")}
    size = within(F.greatest(side["x2"] - side["x1"], side["y2"] - side["y1"]), 1e-300)
    level = lambda s: F.greatest(F.lit(-3), F.ceil(F.log2(s) / 4).cast("int"))
    top = F.least(F.lit(13), level(size * (1.000001 / iou))) if iou > 1e-12 else F.lit(13)  # no side is longer than 16^13
    at = lambda c, g: F.floor(side[c] / F.pow(F.lit(16.0), g) / 2).cast("long")
    span = lambda lo, hi, g: F.sequence(at(lo, g), F.greatest(at(lo, g), at(hi, g)))
    across = lambda g: F.flatten(F.transform(span("x1", "x2", g), lambda x: F.transform(span("y1", "y2", g), lambda y: F.struct(g.alias("_grid"), x.alias("_cx"), y.alias("_cy")))))
    every = boxes.withColumn("_all", F.flatten(F.transform(F.sequence(level(size), top), across)))
    return every.withColumn("_tiles", F.size("_all")).withColumn("_at", F.explode("_all")).select(*boxes.columns, "_tiles", "_at.*")


#: What a tile says of a box: not decided, overlapped by no open or kept box there, overlapped by a kept one.
OPEN, FREE, GONE = 0, 1, 2


def _over(box: np.ndarray, others: np.ndarray, iou: float) -> np.ndarray:
    """Whether each of `others`, four columns in rows, overlaps the box by more than `iou`."""
    w = np.minimum(box[2], others[2]) - np.maximum(box[0], others[0])
    h = np.minimum(box[3], others[3]) - np.maximum(box[1], others[1])
    both = np.maximum(0, w) * np.maximum(0, h)
    area = (box[2] - box[0]) * (box[3] - box[1]) + (others[2] - others[0]) * (others[3] - others[1]) - both
    return both > iou * np.maximum(area, 1e-12)


def settle(boxes: np.ndarray, kept: np.ndarray, alone: np.ndarray, lead: int, iou: float) -> tuple[np.ndarray, np.ndarray]:
    """(what the tile says of each box, the boxes that are kept for certain), for boxes from the strongest on.

    `kept` ones come first and are decided; `alone` ones are in no other tile. The `lead` strongest open boxes are
    compared with all weaker ones, the others of the tile with what is kept only.
    """
    said, blocked, sure = np.zeros(len(kept), np.int8), np.zeros(len(kept), bool), []
    for k in range(min(len(kept), int(kept.sum()) + lead)):
        if said[k] == GONE:
            continue
        if not blocked[k]:
            said[k] = FREE
        over = _over(boxes[:, k], boxes[:, k + 1 :], iou)
        if kept[k] or alone[k] and not blocked[k]:
            said[k + 1 :][over] = GONE
            sure.append(k)
        else:
            blocked[k + 1 :] |= over
    return said, boxes[:, sure]


def _settled(tile: list[str], lead: int, iou: float):
    def told(batch: pa.RecordBatch, said: np.ndarray) -> pa.RecordBatch:
        kept, tiles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_kept", "_tiles"))
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(said)], names=[*batch.schema.names, "_said"])
        return out.filter(pa.array(~kept & ((said != GONE) | (tiles > 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before, front = None, None, None  # front: what is kept of the tile that goes on, its strongest boxes being settled
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            new = changes(batch, before, tile)
            edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), batch.num_rows]
            boxes = np.array([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
            kept, alone = batch.column("_kept").to_numpy(zero_copy_only=False), batch.column("_tiles").to_numpy(zero_copy_only=False) == 1
            said, upto, rest = np.zeros(batch.num_rows, np.int8), batch.num_rows, None
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if front is not None and not new[s]:
                    for k in range(front.shape[1]):
                        said[s:e][_over(front[:, k], boxes[:, s:e], iou)] = GONE
                elif e == batch.num_rows and int((~kept[s:e]).sum()) < lead:
                    rest, upto = batch.slice(s), s  # the tile may go on
                else:
                    said[s:e], front = settle(boxes[:, s:e], kept[s:e], alone[s:e], lead, iou)
            if upto:
                yield told(batch.slice(0, upto), said[:upto])
                before = batch.slice(upto - 1, 1)
        if rest is not None:
            boxes = np.array([rest.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
            kept, alone = rest.column("_kept").to_numpy(zero_copy_only=False), rest.column("_tiles").to_numpy(zero_copy_only=False) == 1
            yield told(rest, settle(boxes, kept, alone, lead, iou)[0])

    return run


def overlap(a: str, b: str) -> Column:
    """Intersection over union of the boxes in the structs `a` and `b`."""
    of = lambda s, c: F.col(f"{s}.{c}")
    side = lambda s, lo, hi: F.greatest(F.lit(0.0), of(s, hi) - of(s, lo))
    both = lambda lo, hi: F.greatest(F.lit(0.0), F.least(of(a, hi), of(b, hi)) - F.greatest(of(a, lo), of(b, lo)))
    common = both("x1", "x2") * both("y1", "y2")
    area = lambda s: side(s, "x1", "x2") * side(s, "y1", "y2")
    return common / F.greatest(area(a) + area(b) - common, F.lit(1e-12))


def nms_rounds(detections: DataFrame, keys: list[str], iou: float = 0.3, most: int = GROUP, leaders: int = 64) -> DataFrame:
    """`class_nms` for groups of any size, spread over tasks by place.

    A round streams through tiles, in each of which the strongest open boxes, 16 times `leaders` at most, meet the
    others, so that a crowded tile makes no square of pairs. A box without a stronger open or kept one over it in any
    of its tiles is kept; one that overlaps a kept one goes. Boxes of one tile are decided there and then, those of
    several by what all of them say, and when kept they take part once more, to take others away. Groups with at most
    `most` open boxes left are finished by the task that holds them. Whole rows go along, few of them more than once:
    nothing is joined. Boxes without an area, or with a side that is null or no number, overlap none and stay.
    """
    if iou >= 1:
        return detections
    tables, names = Tables(detections.sparkSession), detections.columns
    solid = F.coalesce(reduce(and_, [F.abs(c) < 1e15 for c in ("x1", "y1", "x2", "y2")]) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    conf = F.coalesce(F.col("conf").cast("double"), F.lit(float("-inf")))
    rows = tables.write(detections.withColumn("_id", F.monotonically_increasing_id()).withColumn("_kept", F.lit(False)))
    found = [tables.write(rows.where(~solid).select(*names))]
    open_, old = rows.where(solid), [rows]
    tile = [*keys, "_grid", "_cx", "_cy"]
    while open_.where("NOT _kept").groupBy(*keys).count().where(F.col("count") > most).head(1):
        dealt = _tiles(open_, iou).repartition(*tile).sortWithinPartitions(*tile, F.desc("_kept"), -conf, "x1", "y1", "x2", "y2", "_id")
        told = tables.write(dealt.mapInArrow(_settled(tile, 16 * leaders, iou), dealt.withColumn("_said", F.lit(0).cast("byte")).schema).drop("_grid", "_cx", "_cy", "_kept"))
        one = told.where("_tiles = 1").select(*names, "_id", "_tiles", (F.col("_said") == FREE).alias("_kept"))
        several = told.where("_tiles > 1").groupBy("_id", "_tiles").agg(*[F.first(c).alias(c) for c in names], F.max("_said").alias("_most"), F.count_if(F.col("_said") == FREE).alias("_free"))
        both = one.unionByName(several.where(F.col("_most") < GONE).select(*names, "_id", "_tiles", (F.col("_free") == F.col("_tiles")).alias("_kept")))
        won, rest = tables.write(both.where("_kept")), tables.write(both.where("NOT _kept"))
        tables.drop(told, *old)
        found.append(won.select(*names))
        open_, old = rest.unionByName(won.where("_tiles > 1")).drop("_tiles"), [rest]
    # those kept last come before all others of their group
    marked = open_.withColumn("_conf", F.col("conf")).withColumn("conf", F.when(F.col("_kept"), float("inf")).otherwise(conf))
    last = _streamed(marked, keys, iou).where("NOT _kept").withColumn("conf", F.col("_conf")).select(*names)
    found.append(tables.write(last))
    tables.drop(*old)
    return reduce(DataFrame.unionByName, found)


def _kept(pdf: pd.DataFrame, edges: np.ndarray, iou: float) -> np.ndarray:
    boxes, conf = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["conf"].to_numpy(float)
    parts = [s + suppress(boxes[s:e], conf[s:e], iou) if e - s > 1 else np.array([s]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
