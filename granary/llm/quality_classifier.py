"""A quality classifier for graded ratings: cumulative-link (ordinal logistic) regression on hashed text.

One weight vector over hashed words serves all grades; ordered thresholds turn its score into the probability of
each grade, hence an expected grade and the probability of reaching a grade.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounds, chunks, plainly_named, word_codes

SIZE = 1 << 18
#: Rated documents used to fit the model: those with the smallest hashes of their ids.
FIT_DOCUMENTS = 12_000
#: A document stays if the top grade is at least this probable.
MIN_TAIL = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """The probability of grade k + 1 or higher, a column for each cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None] - score[:, None], -60, 60)))


def grade(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for poor, 2 for good text; null where no label says anything."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def _hashed(words: list[str]) -> np.ndarray:
    """Two features of each word: its lower-cased core, and the marks around it."""
    seen: dict[str, int] = {}
    out = np.empty((len(words), 2), np.int64)
    for k, word in enumerate(words):
        core = word.strip(string.punctuation)
        marks = word.replace(core, "\x00", 1) if core else word
        for j, x in enumerate((core.lower(), marks)):
            h = seen.get(x)
            if h is None:
                h = seen[x] = (xxhash.xxh64_intdigest(x) * 2 + j) % SIZE
            out[k, j] = h
    return out


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers text after text, their weights, number of features of each text); each counts log(1 + n)."""
    codes, words, counts = word_codes(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashed = _hashed(words)[codes] if len(codes) else np.zeros((0, 2), np.int64)
    key, n = np.unique((owner[:, None] * SIZE + hashed).ravel(), return_counts=True)
    return key % SIZE, np.log1p(n), np.bincount(key // SIZE, minlength=len(counts))


def _scores(weights: np.ndarray, features: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted mean over a text's features, scaled by the root of their number: one rare word still tells."""
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights[features] * values, len(counts))
    return total / np.maximum(1, counts) ** 0.25


def fit_model(features: np.ndarray, values: np.ndarray, counts: np.ndarray, grades: np.ndarray, levels: int = 3, rounds: int = 120, rate: float = 0.15, ridge: float = 2e-4) -> OrdinalModel:
    """Adam on the mean negative log likelihood. Thresholds stay in order: the first is free, gaps are exponentials."""
    n = len(grades)
    share = np.array([(grades > k).mean() if n else 0.5 for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    gaps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    weights = np.zeros(SIZE)
    m, v = np.zeros(SIZE + len(gaps)), np.zeros(SIZE + len(gaps))
    cuts_of = lambda g: np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))
    owner = np.repeat(np.arange(n), counts)
    scaled = values / np.maximum(1, counts)[owner] ** 0.25
    for t in range(1, rounds + 1 if n else 1):
        cuts = cuts_of(gaps)
        score = np.bincount(owner, weights[features] * scaled, n)
        p = np.concatenate([np.ones((n, 1)), OrdinalModel(weights, cuts).above(score), np.zeros((n, 1))], 1)
        slope = p * (1 - p)
        upper, lower = np.take_along_axis(slope, grades[:, None], 1)[:, 0], np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0]
        mass = np.maximum(np.take_along_axis(p, grades[:, None], 1)[:, 0] - np.take_along_axis(p, grades[:, None] + 1, 1)[:, 0], 1e-9)
        by_score = -(upper - lower) / mass / n
        by_cut = np.zeros(levels - 1)
        np.add.at(by_cut, grades[grades > 0] - 1, (upper / mass)[grades > 0] / n)
        np.add.at(by_cut, grades[grades < levels - 1], -(lower / mass)[grades < levels - 1] / n)
        tail = np.cumsum(by_cut[::-1])[::-1]
        by_gap = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        g = np.concatenate([np.bincount(features, by_score[owner] * scaled, SIZE) + ridge * weights, by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        weights, gaps = weights - step[:SIZE], gaps - step[SIZE:]
    return OrdinalModel(weights.astype(np.float32).astype(np.float64), cuts_of(gaps))


def rated(labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, grade) of at most `most` rated documents; of several ratings of one document the lowest holds."""
    rows = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> OrdinalModel:
    """A model from a bounded sample of rated documents; only their hashed features reach the driver."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, values, counts = text_features(batch.column("text"))
            at = bounds(counts)
            f, v = features.astype(np.int32), values.astype(np.float32)
            cut = lambda x: pa.array([x[at[k] : at[k + 1]].tobytes() for k in range(len(counts))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), cut(f), cut(v)], names=["doc_id", "grade", "features", "vals"])

    sample = docs.select("doc_id", "text").join(F.broadcast(rated(labels, most)), "doc_id")
    table = sample.mapInArrow(featured, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, features binary, vals binary").toArrow()
    rows = table.sort_by([("doc_id", "ascending")])
    parts = [np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in rows.column("vals").to_pylist()]
    empty = np.zeros(0, np.int64)
    return fit_model(np.concatenate(parts).astype(np.int64) if parts else empty, np.concatenate(values).astype(float) if values else empty.astype(float), np.array([len(p) for p in parts], np.int64), np.array(rows.column("grade").to_pylist(), np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, model: OrdinalModel | None = None, min_tail: float = MIN_TAIL) -> DataFrame:
    """`docs` with expected_grade, tail_probability and kept: whether the top grade is probable enough.

    Either a model or labels to fit one on are needed. Whole texts count. A null or empty text has no features, so
    it gets what the thresholds alone say; without ratings the model knows nothing and gives every grade its prior.
    Columns of `docs` of the three names are replaced, all others stay; rows and ids may repeat, and an empty table
    gives an empty result.
    """
    docs, named = plainly_named(docs.drop("expected_grade", "tail_probability", "kept"))
    told = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in chunks(batches, "text"):
            above = model.above(_scores(model.weights, *text_features(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= min_tail)], names=[*names, "expected_grade", "tail_probability", "kept"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return named(docs.mapInArrow(score, f"{schema}, expected_grade double, tail_probability double, kept boolean"))
