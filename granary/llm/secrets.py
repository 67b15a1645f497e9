"""Secrets in texts: fixed shapes by pattern, and unknown ones by the Shannon entropy of a sliding window.

Candidate strings are runs of letters, digits and `+/_-`. A window of WINDOW characters slides over each: entering and
leaving characters change its counts, and with them its entropy, by one step. Which entropy is high depends on the
window's class: hexadecimal digits, digits with letters of one case, or all mixed. Windows over their class's bound
are joined to spans, and spans that an allow-list knows as harmless are left out. Texts stay where they are: no
shuffle, and the step holds a bounded chunk of texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import chunks

#: Shapes that are always found, in the order in which spans that start together are named.
BASE = ("assign", "access", "hex")
CLASSES = ("entropy_hex", "entropy_alnum", "entropy_mixed")
WINDOW = 20
#: Least bits a character, by class. Random strings of 16, 36 and 62 symbols have about 3.5, 3.8 and 4.0 in a window.
BITS = (3.0, 3.5, 3.75)
#: Least digits, letters, and changes between digits, lower and upper letters and the rest, in a window.
DIGITS, LETTERS, CHANGES = 2, 3, 5
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

#: Harmless strings, by what a whole candidate holds.
ALLOWED = (
    rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
    rb"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6}",
    rb"\d{4}-\d{2}-\d{2}T\d{2}",  # times
)
#: Harmless strings, by what stands before them without white space between.
ALLOWED_BEFORE = (
    rb"(?i)(sha(1|256|384|512)|md5)[-:=]$",  # checksums, which are public
    rb"://\S*$",  # addresses
    rb"(?i);base64,$",  # embedded pictures
)
_BEFORE = 256  # bytes before a candidate that the second list sees

# by byte: the symbol's number in a candidate, or -1; and its type
_SYMBOL = np.full(256, -1, np.int8)
_SYMBOL[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", np.uint8)] = np.arange(66)
_DIGIT, _UPPER, _LOWER, _OTHER = range(4)
_TYPE = np.full(256, _OTHER, np.int8)
_TYPE[48:58], _TYPE[65:91], _TYPE[97:123] = _DIGIT, _UPPER, _LOWER
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_HEX_ANY = _HEX.copy()
_HEX_ANY[65:71] = True
_STRETCH = 128  # windows that one row of the table of counts covers


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def window_entropy(data: np.ndarray, start: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bits a character of `count[k]` windows from `start[k]` on, one row for each k; the rest of a row is -1.

    All rows move on together: a step adds each row's next symbol to its counts and takes out the one that leaves.
    """
    width, rows = int(count.max()), np.arange(len(start))
    share = np.arange(window + 2) * np.log2(np.maximum(np.arange(window + 2), 1))  # n log n
    counts, total = np.zeros((len(start), 66), np.int64), np.zeros(len(start))
    out = np.full((len(start), width), -1.0)
    for t in range(width + window - 1):
        open_ = t < count + window - 1
        r = rows[open_]
        come = _SYMBOL[data[start[r] + t]]
        n = counts[r, come]
        total[r] += share[n + 1] - share[n]
        counts[r, come] = n + 1
        if t >= window:
            go = _SYMBOL[data[start[r] + t - window]]
            n = counts[r, go]
            total[r] += share[n - 1] - share[n]
            counts[r, go] = n - 1
        if t >= window - 1:
            out[r, t - window + 1] = np.log2(window) - total[r] / window
    return out


def _in_windows(marks: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[at + window] - total[at]


def _high_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, entropy and class of each window of the candidates that passes its class's bounds."""
    windows = ends - starts - WINDOW + 1
    parts = -(-windows // _STRETCH)  # a long candidate takes several rows, so that no row is longer than the others can be
    k = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
    at, count = starts[k] + nth * _STRETCH, np.minimum(windows[k] - nth * _STRETCH, _STRETCH)
    bits = window_entropy(data, at, count)
    row, col = np.nonzero(bits >= 0)
    place, bits = at[row] + col, bits[row, col]
    kind = _TYPE[data]
    digits, upper, lower, other = (_in_windows(kind == t, place, WINDOW) for t in (_DIGIT, _UPPER, _LOWER, _OTHER))
    change = np.concatenate([kind[1:] != kind[:-1], [False]])
    changes = _in_windows(change, place, WINDOW - 1)
    class_ = np.where(_in_windows(~_HEX_ANY[data], place, WINDOW) == 0, 0, np.where((other == 0) & ((upper == 0) | (lower == 0)), 1, 2))
    passes = (bits >= np.array(BITS)[class_]) & (digits >= DIGITS) & (upper + lower >= LETTERS) & (changes >= CHANGES)
    passes &= (class_ != 2) | ((upper > 0) & (lower > 0))
    return place[passes], bits[passes], class_[passes]


def _ordered(part: bytes) -> bool:
    """Whether most steps of the string go to the same or to the next symbol, as in alphabets and counts."""
    step = np.diff(np.frombuffer(part, np.uint8).astype(int))
    return bool((np.abs(step) <= 1).mean() > 0.5)


def _entropy_spans(text: bytes, data: np.ndarray, allowed: Sequence[re.Pattern], before: Sequence[re.Pattern]) -> Iterator[tuple[int, int, str, float]]:
    starts, ends = _runs(_SYMBOL[data] >= 0, WINDOW)
    if not len(starts):
        return
    place, bits, class_ = _high_windows(data, starts, ends)
    if not len(place):
        return
    new = np.concatenate([[True], place[1:] > place[:-1] + WINDOW])  # windows that touch make one span
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    token = np.searchsorted(starts, place[first], side="right") - 1
    for a, b, k in zip(first.tolist(), last.tolist(), token.tolist(), strict=True):
        start, end = int(place[a]), int(place[b]) + WINDOW
        whole = text[starts[k] : ends[k]]
        if any(p.search(whole) for p in allowed) or _ordered(text[start:end]) or any(p.search(text, max(0, starts[k] - _BEFORE), starts[k]) for p in before):
            continue
        peak = a + int(bits[a : b + 1].argmax())
        yield start, end, CLASSES[class_[peak]], float(bits[peak])


def _scan(texts: list[bytes], allowed: Sequence[re.Pattern], before: Sequence[re.Pattern]) -> list[list[tuple[int, int, str, float | None]]]:
    """Each text's spans in code points, by start and kind. Texts are joined by line ends, which no shape holds."""
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    base = [(m.start(), m.end(), "assign", None) for m in _ASSIGN.finditer(joined) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    base += [(m.start(), m.end(), "access", None) for m in _ACCESS.finditer(joined) if m.end() - m.start() >= ACCESS_CHARS]
    base += [(int(a), int(b), "hex", None) for a, b in zip(*_runs(_HEX[data], HEX_CHARS), strict=True)]
    covered = np.zeros(len(data) + 1, np.int64)
    for a, b, *_ in base:
        covered[a:b] = 1
    inside = np.concatenate([[0], np.cumsum(covered)])
    found = base + [x for x in _entropy_spans(joined, data, allowed, before) if inside[x[1]] - inside[x[0]] < x[1] - x[0]]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    order = {k: n for n, k in enumerate((*BASE, *CLASSES))}
    out: list[list] = [[] for _ in texts]
    for a, b, kind, bits in sorted(found, key=lambda x: (x[0], order[x[2]])):
        k = int(np.searchsorted(bounds, a, side="right")) - 1
        out[k].append((int(points[a] - points[bounds[k]]), int(points[b] - points[bounds[k]]), kind, bits))
    return out


_SPANS = "spans array<struct<kind: string, start: long, end: long, entropy: double>>"


def secret_scan(docs: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """(doc_id, spans): each text's secrets as kind, start, end (code points, end exclusive) and highest entropy.

    Kinds are assign, access and hex by pattern (entropy null), and entropy_hex, entropy_alnum and entropy_mixed by
    windows; spans are ordered by start, then kind. A window's span that spans by pattern cover whole is not repeated.
    `allow`: regular expressions of further harmless candidates; spans by pattern always stay. A null or empty text
    has no spans; texts of any length are read whole. Rows are taken one by one, so that repeated or null doc_ids give
    a row each; no other column is read; an empty table gives an empty result.
    """
    patterns = [*ALLOWED, *(a.encode() for a in allow)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, before = [re.compile(p) for p in patterns], [re.compile(p) for p in ALLOWED_BEFORE]
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            spans = _scan(texts, allowed, before)
            flat = [s for own in spans for s in own]
            kinds, starts, ends, bits = pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.float64())
            struct = pa.StructArray.from_arrays([kinds, starts, ends, bits], names=["kind", "start", "end", "entropy"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, struct)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {_SPANS}")


def redacted(docs: DataFrame, mask: str = "*") -> DataFrame:
    """(doc_id, text) with every character of a secret as `mask`; a text without any stays as it is, a null text too.

    Works a row at a time from the row's own text, so that repeated doc_ids don't mix.
    """

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, before = [re.compile(p) for p in ALLOWED], [re.compile(p) for p in ALLOWED_BEFORE]
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            for k, own in enumerate(_scan([(t or "").encode() for t in texts], allowed, before)):
                if own:
                    chars = list(texts[k])
                    for a, b, *_ in own:
                        chars[a:b] = mask * (b - a)
                    texts[k] = "".join(chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, batch.schema.field("text").type)], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(hide, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from `secret_scan`: numbers and digest of the spans by pattern."""
    found = secret_scan(docs, allow)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(number, BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
