"""Helpers shared by the training-data operators: word splitting, bounded Arrow chunks and shared tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one Python step holds at a time; a single longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    A temporary folder is taken only where the session has none and runs in one process, as in local tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` as a table in the shared folder: evaluated once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table of `written` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; the plain function is faster and agrees where every character is ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _give_back() -> None:
    """Hands freed memory back: a Python worker is used again, and its executor needs the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about `most` bytes together, or hold one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
        _give_back()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's number of words. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists))
    return flat.filter(full), counts


def word_codes(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each word's place in the list of distinct words, that list, and each text's number of words."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), counts


def free_name(name: str, df: DataFrame) -> str:
    """`name`, with as many underscores before it as make it unlike all columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plainly_named(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with names that an Arrow step can resolve in place of those with dots or backticks, and what puts them back."""
    own = {free_name(f"_column{k}", df): c for k, c in enumerate(df.columns) if "." in c or "`" in c}
    back = {c: n for n, c in own.items()}
    return df.toDF(*[back.get(c, c) for c in df.columns]), lambda out: out.toDF(*[own.get(c, c) for c in out.columns])


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's run of values; a text without any has 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    edge = bounds(counts)
    return total[edge[1:]] - total[edge[:-1]]
