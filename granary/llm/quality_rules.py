"""Quality rules with line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate by Viterbi decoding;
the share of characters in content lines decides whether the document stays. Simple counts over words and lines
decide before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounds, chunks, split_words

SYMBOLS = b"#*$%&|<>"
#: Labelled documents used to fit the model: those with the smallest hashes of their ids.
FIT_DOCUMENTS = 3000
MIN_SHARE = 0.5
#: Lines of a sequence that the fit takes together; longer documents are several sequences, all of which count.
FIT_LINES = 256
#: First feature number of each group of line features; the last is their total.
_WORDS, _END, _SYMBOL, _BAR, _DIGIT, _AGAIN, _SEEN, _MARK, _SIZE = 0, 7, 9, 14, 17, 20, 25, 27, 30


def line_features(line: str, seen: set[str]) -> tuple[int, ...]:
    """Numbers of the features that hold for a line, one of each group. `seen` has the lines before it."""
    words = line.split()
    n, size = len(words), max(1, len(line))
    marks = sum(map(line.count, "#*$%&<>"))
    digits = sum(map(line.count, "0123456789"))
    last = line.rstrip()[-1:]
    again = len(set(words)) / n if n else 1.0
    return (
        _WORDS + (0 if n == 0 else 1 if n < 3 else 2 if n < 6 else 3 if n < 11 else 4 if n < 31 else 5 if n < 101 else 6),
        _END + (last in (".", "!", "?", '"')),
        _SYMBOL + (0 if marks == 0 else 1 if marks < 0.01 * size else 2 if marks < 0.05 * size else 3 if marks < 0.15 * size else 4),
        _BAR + (0 if "|" not in line else 1 if line.count("|") < 0.2 * n else 2),
        _DIGIT + (0 if digits == 0 else 1 if digits < 0.1 * size else 2),
        _AGAIN + (0 if again > 0.8 else 1 if again > 0.6 else 2 if again > 0.4 else 3 if again > 0.2 else 4),
        _SEEN + (line in seen),
        _MARK + (2 if "@" in line else 1 if "http" in line else 0),
    )


def _by_place(counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in a sequence, the sequences that reach it, longest first."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        yield t, order[: np.searchsorted(-sizes, -t, side="left")]


def viterbi(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best labels (0 or 1) of sequences laid end to end; emission is the score of label 1 over label 0 by line.

    Equal scores take label 1. All sequences advance together, place by place.
    """
    first = bounds(counts)[:-1]
    best, back = np.zeros((len(counts), 2)), np.zeros((len(emission), 2), np.int8)
    for t, rows in _by_place(counts):
        at = first[rows] + t
        if t:
            stay = best[rows][:, :, None] + transition[None]
            back[at] = stay[:, 1, :] >= stay[:, 0, :]
            best[rows] = stay.max(1)
        best[rows, 1] += emission[at]
    labels = np.zeros(len(emission), np.int8)
    now = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t, rows in reversed(list(_by_place(counts))):
        at = first[rows] + t
        labels[at] = now[rows]
        now[rows] = back[at, now[rows]]
    return labels


def fit_crf(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transitions) by gradient ascent on the conditional likelihood, with forward-backward sums."""
    weights, transition = np.zeros(_SIZE), np.zeros((2, 2))
    if not len(labels):
        return weights, transition
    first, n = bounds(counts)[:-1], len(labels)
    places = list(_by_place(counts))
    inner = np.ones(n, bool)
    inner[first[counts > 0]] = False
    prior, after = labels[np.flatnonzero(inner) - 1], labels[inner]
    seen = np.zeros((2, 2))
    np.add.at(seen, (prior, after), 1)
    for k in range(rounds):
        emission = np.stack([np.zeros(n), weights[features].sum(1)], 1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for t, rows in places:
            at = first[rows] + t
            ahead[at] = emission[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + transition[None], axis=1) if t else 0)
        for t, rows in reversed(places):
            rows = rows[counts[rows] > t + 1]
            at = first[rows] + t
            behind[at] = np.logaddexp.reduce(transition[None] + (emission + behind)[at + 1][:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead + behind, axis=1)
        p = np.exp(ahead[:, 1] + behind[:, 1] - total)
        grad = np.bincount(features.ravel(), np.repeat(labels - p, features.shape[1]), _SIZE)
        at = np.flatnonzero(inner)
        pair = np.exp(ahead[at - 1][:, :, None] + transition[None] + (emission + behind)[at][:, None, :] - total[at][:, None, None]).sum(0)
        often = np.bincount(features.ravel(), minlength=_SIZE)
        weights += rate * (grad / (0.05 * often + 20) - ridge * weights)
        transition += rate * ((seen - pair) / (0.25 * max(1, len(at)) + 20) - ridge * transition)
    return weights, transition


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most `most` labelled documents, whose lines all take the document's quality label.

    Documents of more than FIT_LINES lines are fitted as several sequences; decoding takes them whole.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                seen: set[str] = set()
                row = []
                for line in (text or "").split("\n"):
                    row.append(line_features(line, seen))
                    seen.add(line)
                rows.append(np.array(row, np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "features"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(featured, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, features binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["features"])))
    width = len(line_features("", set()))
    each = [np.frombuffer(r["features"], np.uint8).reshape(-1, width) for r in rows]
    counts = np.array([len(x) for x in each], np.int64)
    parts = np.array([min(FIT_LINES, n - s) for n in counts.tolist() for s in range(0, n, FIT_LINES)], np.int64)
    return fit_crf(np.concatenate(each) if each else np.zeros((0, width), np.uint8), parts, np.repeat(np.array([r["quality"] for r in rows], np.int64), counts))


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words covered by three-word windows that occur twice or more; codes number the words of one text."""
    if len(codes) < 4:
        return 0
    if distinct < 2_000_000:
        key = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    else:
        key = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)[1] * distinct + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + len(key)] |= twice
    return int(covered.sum())


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, model: tuple[np.ndarray, np.ndarray] | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, content_lines,
    content_share, kept), one row per row of `docs`; either a fitted model or labels to fit one on are needed.

    content_share is the share of a text's word characters in lines marked as content (1 without any). A null or
    empty text has no words and fails. Texts are judged whole; ids and texts may repeat. Without usable labels the
    model is flat and marks every line as content.
    """
    weights, transition = model or fit(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, counts = split_words(batch.column("text"))
            coded = flat.dictionary_encode()
            codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            edge = bounds(counts)
            sizes = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False))])
            texts = [t or "" for t in batch.column("text").to_pylist()]
            symbols, dups, features, inside, lines = [], [], [], [], []
            for text in texts:
                raw = text.encode()
                symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
                seen: set[str] = set()
                own = text.split("\n")
                dup = 0
                for line in own:
                    if line in seen and line.strip(" \t\n\v\f\r"):
                        dup += 1
                    features.append(line_features(line, seen))
                    inside.append(len(line) - line.count(" "))
                    seen.add(line)
                dups.append(dup)
                lines.append(len(own))
            lines = np.array(lines, np.int64)
            content = viterbi(weights[np.array(features, np.int64).reshape(-1, 8)].sum(1), lines, transition)
            at = bounds(lines)[:-1]
            inside = np.array(inside, np.float64)
            whole = np.add.reduceat(inside, at) if len(at) else inside
            share = np.where(whole > 0, np.add.reduceat(inside * content, at) / np.maximum(whole, 1), 1.0) if len(at) else whole
            repeats = np.array([repeated_words(codes[edge[k] : edge[k + 1]], distinct) for k in range(len(counts))], np.int64)
            failed = (counts < 50) | (100 * repeats > 50 * counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (counts.astype(np.int64), (sizes[edge[1:]] - sizes[edge[:-1]]).astype(np.int64))), pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()), pa.array(repeats), pa.array(failed), pa.array(lines), pa.array(np.add.reduceat(content.astype(np.int64), at) if len(at) else lines), pa.array(share), pa.array(~failed & (share >= min_share))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "content_lines", "content_share", "kept"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, content_lines long, content_share double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
