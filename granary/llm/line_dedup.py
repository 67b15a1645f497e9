"""Removing lines that several documents share, by range-partitioned hashes.

Line keys are hashed to 128 bits, range-partitioned by hash, document and position and sorted within partitions, so
that a stream over each partition meets a key's first document first. A key may run over many partitions: rows of
a partition's first key wait until the first document of the whole run is known. The result is a compressed bitmap
of kept lines for every document that loses any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, chunks, free_name, plainly_named, written

MIN_CHARS = 10
_SPACE = " \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, n_lines, pos) for each line whose key is long enough."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(lines).alias("n_lines"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("doc_id", "text_hash", "n_lines", "pos", ascii_lower(F.btrim("line", F.lit(_SPACE))).alias("key")).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "n_lines", "pos")


_DROPPED, _WAITING, _LAST = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys whose first document is another (0), all rows of the first key (1), the last key's owner (2)."""
    owner, opened, run = None, True, None  # of the key that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        doc = batch.column("doc_id")
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        same = run == (h1[0], h2[0])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        owners = doc.take(pa.array(starts)).to_pylist()
        if same:
            owners[0] = owner
        else:
            opened = run is None
        ids = doc.to_numpy(zero_copy_only=False)
        own = np.array(owners, dtype=object)[which] if doc.null_count else np.array(owners)[which]
        differs = np.array([a != b for a, b in zip(doc.to_pylist(), own, strict=True)]) if doc.null_count else ids != own
        kind = np.where(which == 0, _WAITING, _DROPPED) if opened else np.zeros(len(which), int)
        rows = np.flatnonzero(differs | (kind == _WAITING))
        if len(rows):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in _COLUMNS), pa.array(kind[rows].astype(np.int32))], names=[*_COLUMNS, "kind"])
        opened, owner, run, last = opened and len(starts) == 1, owners[-1], (h1[-1], h2[-1]), batch
    if run is not None:
        one = [pa.array([x], last.schema.field(c).type) for c, x in zip(_COLUMNS, (int(run[0]), int(run[1]), owner, 0, 0, 0), strict=True)]
        yield pa.RecordBatch.from_arrays([*one, pa.array([_LAST], pa.int32())], names=[*_COLUMNS, "kind"])


_COLUMNS = ["h1", "h2", "doc_id", "text_hash", "n_lines", "pos"]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep): zlib-compressed bits, first line highest, 1 for a kept line.

    Documents without a row keep all lines. A document is a doc_id: rows that repeat one, or that have none, count
    as one document, and no doc_id comes after every other. text_hash tells rows of one doc_id with unlike texts apart.
    """
    keys = written(line_keys(docs, min_chars))  # the partitioner reads it twice, to draw its bounds and to deal it
    dealt = keys.repartitionByRange("h1", "h2", F.col("doc_id").asc_nulls_last(), "text_hash", "pos").sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_last(), "text_hash", "pos")
    kind = dict(docs.dtypes)["doc_id"]
    found = written(dealt.mapInArrow(_stream, f"h1 long, h2 long, doc_id {kind}, text_hash long, n_lines int, pos int, kind int"))
    waiting = found.where(f"kind = {_WAITING}")
    # one key per partition at most waits or ends it, so that this table has two rows per partition at most
    ends = found.where(f"kind IN ({_WAITING}, {_LAST})").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    late = waiting.join(F.broadcast(ends), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    columns = ["doc_id", "text_hash", "n_lines", "pos"]
    lost = found.where(f"kind = {_DROPPED}").select(columns).unionByName(late.select(columns))
    gone = lost.groupBy("doc_id", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dropped = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
                bits = np.ones(n, np.uint8)
                bits[places.values.to_numpy()] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return gone.mapInArrow(bitmap, f"doc_id {kind}, text_hash long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with each text's kept lines joined by line ends, and n_lines and n_dropped; a null text becomes empty."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    doc, hash_, kept, dropped = (free_name(x, docs) for x in ("_doc", "_hash", "_keep", "_dropped"))
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.col("keep").alias(kept), F.col("n_dropped").alias(dropped))
    joined = docs.join(marks.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left").drop(doc, hash_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, lines = batch.column("text").to_pylist(), []
            for k, keep in enumerate(batch.column(kept).to_pylist()):
                texts[k] = texts[k] or ""
                lines.append(texts[k].count("\n") + 1)
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=lines[-1])
                    texts[k] = "\n".join(x for x, b in zip(texts[k].split("\n"), bits.tolist(), strict=True) if b)
            own = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), batch.column(dropped).fill_null(0).cast(pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.mapInArrow(cut, f"{schema}, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without the lines that an earlier document has, and n_lines (before) and n_dropped.

    Columns of `docs` of these two names are replaced, all others stay. Lines compare without outer white space and with A-Z
    lower-cased; shorter keys than `min_chars` code points always stay, and so do repeats inside one document. A null or empty
    text is one empty line and comes out empty; rows that repeat a doc_id, or have none, count as one document, and
    rows without one lose a shared line to any other; an empty table gives an empty result.
    """
    docs, named = plainly_named(docs)
    return named(apply_bitmaps(docs, keep_bitmaps(docs, min_chars)))
