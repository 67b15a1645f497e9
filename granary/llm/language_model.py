"""Scoring texts with a hashed maximum-entropy model.

Words belong to classes and, inside these, to smaller ones. The class of the next word, and then its smaller class,
are predicted by log-linear models over hashed features of the words before it (n-grams and skips), the word within
its smaller class by relative frequency: a class-factored softmax of three factors. The commonest words, a fixed
number, are numbered and sent to every task; all other words form one class, and their exact counts are joined by
word. Word counts, class signatures and gradients are sums over all training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounds, chunks, split_words, sums, written

#: The token that ends every text; no word can equal it.
END = "\n"
HEAD = 1 << 17
#: Classes, and smaller ones in each; words that classes are told apart by; features of a context.
CLASSES, ANCHORS, CONTEXTS = 32, 48, 4
#: Most rows of a weight table: a model is two tables of ROWS * CLASSES numbers, 8 MB together.
ROWS = 1 << 15
#: Gradient rounds, each over all training texts.
ROUNDS = 3
#: Partitions whose sums are added up together before all are.
MERGED = 512
_STEP, _PIECE, _MOST = 1 << 13, 256, 15.0
_ONES, _UPTO = np.ones(CLASSES, np.float32), np.triu(np.ones((CLASSES, CLASSES), np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) sums, gathered over about two million rows before they leave the task."""
    parts, rows = [], 0

    def merged() -> Iterator[pa.RecordBatch]:
        if parts:
            yield from pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    for batch in chunks(batches, "text"):
        found = split_words(pc.ascii_lower(batch.column("text")))[0].value_counts()
        parts.append(pa.table({"word": pa.concat_arrays([found.field("values").cast(pa.string()), pa.array([END])]), "n": pa.concat_arrays([found.field("counts"), pa.array([batch.num_rows], pa.int64())])}))
        rows += len(found)
        if rows > 2_000_000:
            yield from merged()
            parts, rows = [], 0
    yield from merged()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column `text`, the ending token of each text included."""
    return texts.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encode(docs: DataFrame, head) -> DataFrame:
    """(doc_id, held_out, ids, tail): word numbers as binary int32, and the words that have none."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = head.value
        k = len(words)
        end = pc.index(words, END).as_py() if k else k
        for batch in chunks(batches, "text"):
            flat, counts = split_words(pc.ascii_lower(batch.column("text")))
            coded = flat.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), k).to_numpy(zero_copy_only=False).astype(np.int32)
            own = number[codes] if len(codes) else np.zeros(0, np.int32)
            ends = np.cumsum(counts) + np.arange(len(counts))
            ids = np.full(len(own) + len(counts), end, np.int32)
            inner = np.ones(len(ids), bool)
            inner[ends] = False
            ids[inner] = own
            rare = own == k
            tail = pa.ListArray.from_arrays(pa.array(bounds(sums(rare.astype(np.int64), counts)).astype(np.int32)), flat.filter(pa.array(rare)))
            data = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.append(0, ends + 1) * 4).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), data, tail], names=["doc_id", "held_out", "ids", "tail"])

    return docs.mapInArrow(numbered, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, ids binary, tail array<string>")


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, each one's place in its text, and each text's length."""
    column = batch.column("ids")
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    ids = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return ids, np.arange(len(ids)) - np.repeat(bounds(counts)[:-1], counts), counts


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up compressed pieces of one table by piece number; a task holds its pieces' sums only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.float32)
            total[k] = total[k] + part if k in total else part.astype(np.float64)
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.astype(np.float32).tobytes(), 1)], pa.binary())], names=["piece", "data"])


def _table(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of all tasks' tables. Many tasks' are added up in groups first, so that no task reads all of a piece."""
    groups = -(-parts.rdd.getNumPartitions() // MERGED)
    if groups > 1:
        parts = parts.withColumn("group", F.spark_partition_id() % groups).repartition("piece", "group").drop("group").mapInArrow(_added, "piece int, data binary")
    out = np.zeros((rows, width))
    for r in parts.repartition("piece").mapInArrow(_added, "piece int, data binary").collect():
        data = np.frombuffer(zlib.decompress(r["data"]), np.float32).reshape(-1, width)
        out[r["piece"] * _PIECE : r["piece"] * _PIECE + len(data)] = data
    return out


def _pieces(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(table), _PIECE):
        part = table[k : k + _PIECE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // _PIECE], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(part).tobytes(), 1)], pa.binary())], names=["piece", "data"])


def _signatures(encoded: DataFrame, k: int) -> np.ndarray:
    """How often each numbered word comes within three words after each of the commonest ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, ANCHORS), np.float32)
        for batch in chunks(batches, "ids"):
            ids, place, _ = _runs(batch)
            for back in (1, 2, 3):
                at = np.flatnonzero((place >= back) & (ids < k))
                at = at[ids[at - back] < ANCHORS]
                total += np.bincount(ids[at].astype(np.int64) * ANCHORS + ids[at - back], minlength=k * ANCHORS).reshape(k, ANCHORS)
        yield from _pieces(total)

    return _table(encoded.mapInArrow(count, "piece int, data binary"), k, ANCHORS)


def word_classes(signature: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of words by spherical k-means on which common words come before them; the last class is for others."""
    share = signature.sum(0) + 1
    x = np.log1p(signature / np.maximum(counts, 1)[:, None] * (share.sum() / share)[None])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    known = np.flatnonzero(x.any(1))[: 1 << 14]
    if len(known) < classes:
        return np.arange(len(counts)) % classes
    centre = [int(known[0])]
    near = x[known] @ x[centre[0]]
    while len(centre) < classes:  # the word least like any centre so far comes next, by weight
        far = int(((1 - near) * np.sqrt(counts[known])).argmax())
        centre.append(int(known[far]))
        near = np.maximum(near, x[known] @ x[centre[-1]])
    middle = x[centre]
    for _ in range(rounds):
        own = (x @ middle.T).argmax(1)
        for c in range(classes):
            total = (x[own == c] * np.sqrt(counts[own == c])[:, None]).sum(0)
            if total.any():
                middle[c] = total / np.linalg.norm(total)
    return (x @ middle.T).argmax(1)


@dataclass(frozen=True)
class Model:
    """Weights and biases of the classes and of the smaller ones, each word's two classes and its log10 share of them.

    Rows of `inner` belong to one class each. The last word number and class stand for all words without a number.
    """

    outer: np.ndarray
    outer_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    within: np.ndarray


def _features(ids: np.ndarray, place: np.ndarray, classes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two tables for each word's context: the word before, the two before, and two skips."""
    back = []
    for k in (1, 2, 3):
        b = np.full(len(ids), -1, np.int64)
        b[k:] = ids[:-k]
        b[place < k] = -1
        back.append((b + 2).astype(np.uint64))
    one, two, three = back
    keys = np.stack([one, (one << np.uint64(24)) ^ two ^ np.uint64(1 << 50), two ^ np.uint64(2 << 50), three ^ np.uint64(3 << 50)], 1)
    mixed = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
    each = rows // CLASSES  # powers of two, like rows
    return mixed & (rows - 1), (mixed & (each - 1)) + (classes * each)[:, None]


def _steps(ids: np.ndarray, place: np.ndarray, model: Model) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of the words: both tables' rows of their contexts, and the words' classes and smaller classes."""
    for s in range(0, len(ids), _STEP):
        before = max(0, s - 3)
        own = ids[before : s + _STEP]
        c = model.classes[own]
        outer, inner = _features(own, place[before : s + _STEP], c, len(model.outer))
        yield slice(s, s + _STEP), outer[s - before :], inner[s - before :], c[s - before :], model.parts[own[s - before :]]


def _scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weights and biases, at most 4 * _MOST, so that exponentials need no shift."""
    out = weights.take(rows[:, 0], 0)
    for k in range(1, CONTEXTS):
        out += weights.take(rows[:, k], 0)
    out += bias
    return out


def word_scores(model: Model, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 probability of each word after those before it; for the last number, of all words without one together."""
    got = model.within[ids].astype(np.float64)
    for at, outer, inner, c, part in _steps(ids, place, model):
        for z, y in ((_scores(model.outer, model.outer_bias, outer), c), (_scores(model.inner, model.inner_bias[c], inner), part)):
            got[at] += (z[np.arange(len(y)), y] - np.log(np.exp(z) @ _ONES)) / np.log(10)
    return got


def _drawn(z: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """One class for each row, with the chances that the scores give."""
    upto = np.exp(z) @ _UPTO
    below = np.packbits(upto <= upto[:, -1:] * draw.random((len(z), 1), np.float32), axis=1).view(np.uint32)
    return np.minimum(np.bitwise_count(below).ravel(), CLASSES - 1).astype(np.int64)


def _counted(encoded: DataFrame, state, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """By table row, how often each class was seen there (turn 0) or how often the model expects it (later turns).

    The expectation is that of one class drawn from the model at every word of each training text. Its mean is the
    exact one: sums over all texts have little noise, and a word costs one count in place of one for every class.
    Draws are fixed by the words themselves, so that a task that runs again gives the same sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        rows = len(model.outer)
        total = np.zeros(2 * rows * CLASSES, np.float64)
        for batch in chunks(batches, "ids"):
            ids, place, _ = _runs(batch)
            draw = np.random.default_rng(zlib.crc32(ids.tobytes()))
            part = np.zeros(len(total), np.int64)
            for _, outer, inner, c, own in _steps(ids, place, model):
                if turn:
                    own = _drawn(_scores(model.inner, model.inner_bias[c], inner), draw)
                    c = _drawn(_scores(model.outer, model.outer_bias, outer), draw)
                np.add.at(part, (outer * CLASSES + c[:, None]).ravel(), 1)
                np.add.at(part, ((inner + rows) * CLASSES + own[:, None]).ravel(), 1)
            total += part
        yield from _pieces(total.reshape(-1, CLASSES).astype(np.float32))

    rows = len(state.value.outer)
    both = _table(encoded.mapInArrow(count, "piece int, data binary"), 2 * rows, CLASSES)
    return both[:rows], both[rows:]


def _prior(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares, and their logarithms with a very low one for a class without words."""
    share = total / np.maximum(total.sum(-1, keepdims=True), 1e-300)
    return share, np.where(share > 0, np.log(np.maximum(share, 1e-300)), -1e9).astype(np.float32)


def fit(encoded: DataFrame, k: int, counts: np.ndarray, tail: tuple[int, int], rounds: int = ROUNDS, rate: float = 0.35, smooth: float = 400.0) -> Model:
    """The model of `k` numbered words with these counts, and of the others' count and number, from all training texts.

    Every round sends the model out, sums over all training texts how often each feature and class are expected
    together, and moves each weight by the log of seen over expected: a gradient step scaled by the expectation,
    whose length falls with shared features. The first round's expectation follows from the counts.
    """
    signature = _signatures(encoded, k) if k else np.zeros((0, ANCHORS))
    outer = word_classes(signature, counts, CLASSES - 1) if k else np.zeros(0, np.int64)
    inner = np.zeros(k, np.int64)
    for c in range(CLASSES - 1):
        own = np.flatnonzero(outer == c)
        if len(own):
            inner[own] = word_classes(signature[own], counts[own], CLASSES)
    classes, parts = np.append(outer, CLASSES - 1).astype(np.int64), np.append(inner, 0).astype(np.int64)
    often = np.append(counts, tail[0]) + np.append(np.ones(k), tail[1] + 1)  # add one for each known word and the unknown
    size = np.bincount(classes * CLASSES + parts, often, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    outer_prior, outer_bias = _prior(size.sum(1))
    inner_prior, inner_bias = _prior(size)
    within = np.append(np.log10(often[:k] / size[classes[:k], parts[:k]]), 0.0)
    rows = 1 << int(np.clip(np.log2(counts.sum() + tail[0] + 1) - 6, 10, np.log2(ROWS)))
    of_row = np.repeat(inner_prior, rows // CLASSES, axis=0)
    zero = np.zeros((rows, CLASSES), np.float32)
    model = Model(zero, outer_bias, zero, inner_bias, classes, parts, within)
    for n in range(rounds):
        state = encoded.sparkSession.sparkContext.broadcast(model)
        if n == 0:
            seen = _counted(encoded, state, 0)
            hoped = seen[0].sum(1, keepdims=True) * outer_prior, seen[1].sum(1, keepdims=True) * of_row
        else:
            hoped = _counted(encoded, state, n)
        step = [np.where(p > 0, np.log((s + smooth * p + 1e-9) / (h + smooth * p + 1e-9)), 0) for s, h, p in zip(seen, hoped, (outer_prior, of_row), strict=True)]
        outer_weights, inner_weights = (np.clip(w + rate * x, -_MOST, _MOST).astype(np.float32) for w, x in zip((model.outer, model.inner), step, strict=True))
        model = Model(outer_weights, outer_bias, inner_weights, inner_bias, classes, parts, within)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def lm_score(docs: DataFrame, held: Column | None = None, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`.

    score is the log10 probability of the whole text with its ending; base_score that of an add-one unigram model.
    Texts with `held` true (by default a seventh, by a checksum of the id) are not learned from. A null or empty text
    is its ending alone; texts are scored whole; ids and rows may repeat and may be null. `head` words are numbered,
    the ending always among them; what is sent to every task is bounded by that number. Without training texts all
    words are unknown. An empty table gives an empty result; other columns are not read.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(rows.where(~F.col("held_out"))))
    n, v = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("n") > 1) | (F.col("word") == END)).orderBy((F.col("word") == END).desc(), F.desc("n"), "word").limit(head).toArrow().combine_chunks()
    words, often = pa.concat_arrays(top.column("word").chunks) if top.num_rows else pa.array([], pa.string()), top.column("n").to_numpy().astype(np.float64)
    k = len(words)
    tail_n, tail_v = int(n - often.sum()), v - k
    spark = docs.sparkSession
    encoded = written(_encode(rows, spark.sparkContext.broadcast(words)).withColumn("row", F.monotonically_increasing_id()))
    model = fit(encoded.where(~F.col("held_out")).select("ids"), k, often, (tail_n, tail_v), rounds)
    state = spark.sparkContext.broadcast((model, np.append(np.log10(often + 1), 0.0), np.append(np.ones(k, np.int64), 0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, plain, known = state.value
        for batch in chunks(batches, "ids"):
            ids, place, counts = _runs(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(x) for x in (counts, sums(known[ids], counts), sums(plain[ids], counts), sums(word_scores(model, ids, place), counts))], names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"])

    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(score, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, head_known long, head_base double, head_score double")
    rare = encoded.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.count("n").alias("t_known"), F.sum(F.log10(c + 1)).alias("t_base"), F.sum(F.log10((c + 1) / F.lit(float(tail_n + tail_v + 1)))).alias("t_score"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("t_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("t_base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("head_score") + zero("t_score")).alias("score"),
    )
