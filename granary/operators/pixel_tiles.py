"""Pixels (keys, x, y) dealt by square tiles, each of which is in one task: as many pixels as a tile has at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import changes

#: Side of a tile in pixels.
SIDE = 512
TILE = ["_ty", "_tx"]


def of(c: Column) -> Column:
    return F.floor(c.cast("long") / SIDE).cast("long")


def dealt(tiled: DataFrame, *keys: str) -> DataFrame:
    """Rows with `_ty` and `_tx`, each tile of a mask in one partition and in reading order."""
    return tiled.repartition(*keys, *TILE).sortWithinPartitions(*keys, *TILE, "y", "x")


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], repeats: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, whether each begins a tile, x, y) of whole tiles; only the tile that goes on is held. Without `repeats` a pixel counts once."""
    rest, tile = None, [*keys, *TILE]
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        new = changes(batch, None, tile)
        if not repeats:
            x, y = places(batch)
            other = new | np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            batch, new = batch.filter(pa.array(other)), new[other]
        last = int(np.flatnonzero(new)[-1])
        rest = batch.slice(last)
        if last:
            yield batch.slice(0, last), new[:last], *places(batch.slice(0, last))
    if rest is not None:
        yield rest, changes(rest, None, tile), *places(rest)


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, y = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    return x, y


def codes(batch: pa.RecordBatch, new: np.ndarray, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
    """A number for each place, tile by tile: 1 to the right is 1 more, 1 down is `side` + 4 more, also just beyond a tile's sides."""
    ty, tx = (batch.column(c).to_numpy(zero_copy_only=False) for c in TILE)
    return (np.cumsum(new) * (side + 4) + y - ty * side + 1) * (side + 4) + x - tx * side + 1

