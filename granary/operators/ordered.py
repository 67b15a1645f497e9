"""Running sums, positions, rolling windows and percentiles in an order, without a key's rows meeting in one task.

Rows are range-partitioned by key and order and sorted within partitions, so that a key's rows may run over many of
them. A pass over each partition adds running sums within it; the sums of the runs at partitions' ends, two rows a
partition at most, then give what each partition has to add to its first run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.shared import Tables

#: Rows of one key that a rolling window's group holds besides its halo.
BLOCK = 1 << 14


def changes(batch: pa.RecordBatch, before: pa.RecordBatch | None, keys: list[str]) -> np.ndarray:
    """Whether each row's key is another than the row's before it; nulls are a key of their own."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for k in keys:
        col = batch.column(k)
        col = pa.concat_arrays([before.column(k), col]) if before is not None else col
        codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[len(new) - len(codes) + 1 :] |= codes[1:] != codes[:-1]
    return new


def _pass(keys: list[str], sums: dict[str, str], types: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, carry, head, held = TaskContext.get().partitionId(), None, {}, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes(batch, before, keys)
            starts = np.flatnonzero(new)
            if held is not None:  # a run ends where the next batch begins with another key
                yield _marked(held, bool(new[0]), False)
            columns = []
            for name, source in sums.items():
                value = np.ones(batch.num_rows, np.int64) if source is None else batch.column(source).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                base = np.concatenate([[-carry.get(name, 0)], (total - value)[starts]])
                local = total - base[np.cumsum(new)]
                carry[name] = local[-1]
                columns.append(pa.array(local, types[name]))
            still = np.cumsum(new) - (before is None) == 0
            is_head = still if head else np.zeros(len(new), bool)
            last = np.concatenate([new[1:], [False]]) & is_head
            head = bool(is_head[-1])
            held = pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(len(new), part, np.int32)), pa.array(is_head), pa.array(last)], names=[*batch.schema.names, *sums, "_part", "_head", "_edge"])
            before = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield _marked(held, True, True)

    return run


def _marked(batch: pa.RecordBatch, ends: bool, final: bool) -> pa.RecordBatch:
    """Marks the last row as the end of a run that is a partition's first or last."""
    edge = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).copy()
    edge[-1] = edge[-1] or final or ends and batch.column(batch.num_columns - 2)[-1].as_py()
    return batch.set_column(batch.num_columns - 1, "_edge", pa.array(edge))


def running(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, str | None], tables: Tables) -> DataFrame:
    """`df` with a column for each name in `sums`: the sum of a column (null: the number of rows) up to each row of its
    key, itself included.

    Rows of one key are taken in `order`, and those that tie in any; null keys are a key, null values add nothing.
    Columns `_part`, `_head` and `_edge` must not be in `df`. An empty table gives an empty one.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = dict(df.dtypes)
    sql = {n: "double" if s and kinds[s] in ("double", "float") else "bigint" for n, s in sums.items()}
    types = {n: pa.float64() if k == "double" else pa.int64() for n, k in sql.items()}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{n}` {k}" for n, k in sql.items()), "_part int, _head boolean, _edge boolean"])
    table = tables.write(dealt.mapInArrow(_pass(keys, sums, types), schema))
    # two rows a partition: sums of its first run, and of its last; what stands before a first run is the sum of earlier ones of its key
    edges = table.where("_edge").select(*keys, *sums, "_part", "_head")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("_part", "_head", *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast(sql[n]).alias(f"_{n}") for n in sums]).where("_head").drop("_head")
    out = table.join(F.broadcast(carried), "_part")
    return out.select(*df.columns, *[F.when(F.col("_head"), F.col(n) + F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in sums])


def rolling(df: DataFrame, keys: list[str], order: list[Column | str], size: int, aggregates: dict[str, Column], tables: Tables, block: int = BLOCK) -> DataFrame:
    """`df` with `aggregates` over the last `size` rows of each row's key, itself included.

    Positions deal the rows of a key into blocks, and each block gets the `size` - 1 rows before it as a halo: windows
    then run within blocks, however many rows a key has, or all rows where there are no keys.
    """
    block = max(block, size)
    placed = running(df, keys, order, {"_position": None}, tables)
    at = F.col("_position") - 1
    own = F.floor(at / block).cast("long")
    placed = placed.withColumn("_block", F.explode(F.when((at % block >= block - size + 1), F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_block").orderBy("_position").rowsBetween(1 - size, 0)
    return placed.withColumns({n: a.over(w) for n, a in aggregates.items()}).where(own == F.col("_block")).drop("_block", "_position")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], tables: Tables) -> DataFrame:
    """(keys, n, mean, a column for each of `shares`): exact percentiles, between two ranks by their distance.

    Nulls are left out; a key without any value gets nulls and n = 0, and null keys are a key. Equal values are counted
    first, and ranks read off running sums of the counts, so that no task holds a key's values.
    """
    plain = df.select(*keys, F.lit(0).alias("_one"), F.col(value).cast("double").alias("_value"))
    own = [*keys, "_one"]
    counted = tables.write(plain.groupBy(*own, "_value").agg(F.count("*").alias("_n")))
    there = F.col("_value").isNotNull()
    totals = counted.groupBy(*own).agg(F.coalesce(F.sum(F.when(there, F.col("_n"))), F.lit(0)).alias("n"), (F.sum(F.col("_value") * F.col("_n")) / F.sum(F.when(there, F.col("_n")))).alias("mean"))
    totals = tables.write(totals)
    ranked = running(counted.where(there), own, ["_value"], {"_upto": "_n"}, tables)
    place = {name: (F.col("n") - 1) * F.lit(q) for name, q in shares.items()}
    rank = lambda p, f: f(F.round(p, 9)).cast("long") + 1
    wanted = F.array_distinct(F.array(*[rank(p, f) for p in place.values() for f in (F.floor, F.ceil)]))
    mine = totals.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(own)], "n", F.explode(wanted).alias("_asked")).where("n > 0").drop("n")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(own)])
    hit = ranked.join(mine, same & (F.col("_asked") <= F.col("_upto")) & (F.col("_asked") > F.col("_upto") - F.col("_n")))
    at = hit.groupBy(*[f"_of{i}" for i in range(len(own))]).agg(F.map_from_entries(F.collect_list(F.struct("_asked", "_value"))).alias("_at"))
    low, high = (lambda p: F.col("_at")[rank(p, F.floor)]), (lambda p: F.col("_at")[rank(p, F.ceil)])
    between = lambda p: low(p) + (high(p) - low(p)) * (p - F.floor(F.round(p, 9)))
    out = totals.join(at, same, "left")
    return out.select(*keys, "n", "mean", *[F.when(F.col("n") > 0, between(p)).alias(name) for name, p in place.items()])
