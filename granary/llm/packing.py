"""Packing documents into fixed-length sequences by a configuration linear program.

Every document is tokenised and cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths,
at most `capacity` numbers whatever the corpus, reaches the driver. A covering program over it, with one variable
for each multiset of lengths that fits a sequence, is solved fractionally by multiplicative weights: lengths carry
prices, the best configuration under them is found by knapsack dynamic programming and its share raised, and covered
lengths lose price. The shares are rounded down; what that leaves over is packed best fit, largest first. The plan
maps ranks within a length to places in sequences, so that placing the pieces takes one shuffle of narrow rows.
"""

from __future__ import annotations

import os
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import bounds, chunks, free_name, split_words, written

CAPACITY = 2048
#: Pieces of one length that are ranked together.
DEAL_ROWS = 50_000
#: Distinct runs of letters or marks, and other words, whose ids a Python worker remembers: about 50 MB.
REMEMBERED_RUNS = 250_000
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "[!-&(-/:-@\\[-`{-~]*"
_LATIN = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def _byte_letters() -> dict[int, str]:
    """Code point -> its UTF-8 bytes written in the printable alphabet of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


class WordEncoder:
    """Token ids of single words; a text's ids are those of its words, since tokens never span white space.

    Words of Latin letters followed by ASCII punctuation go to the vocabulary's model directly, letters and marks each
    for themselves, all others, those with special tokens in them too, through the whole tokenizer. Both ways give the
    ids that the tokenizer gives for the whole text. A worker keeps the ids of runs and other words that it has met
    in one flat array, emptied when there are many; words are put together from them column by column.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.place = {"": 0}  # another word than a run is known by itself after a space
        self.ids, self.edge = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Keeps the ids of these distinct parts: part k has ids[edge[k]:edge[k + 1]]."""
        model, letters = self.model, self.letters
        known = [None if p[0] == " " else [t.id for t in model.tokenize(p if p.isascii() else p.translate(letters))] for p in parts]
        others = [k for k, p in enumerate(parts) if p[0] == " "]
        for k, e in zip(others, self.tokenizer.encode_batch_fast([parts[k][1:] for k in others], add_special_tokens=False), strict=True):
            known[k] = e.ids
        n, size = len(self.place), np.fromiter(map(len, known), np.int64, len(parts))
        end = self.edge[n] + np.cumsum(size)
        while len(self.edge) < n + len(parts) + 1:
            self.edge = np.concatenate([self.edge, np.zeros_like(self.edge)])
        while len(self.ids) < end[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.edge[n] : end[-1]] = np.fromiter(chain.from_iterable(known), np.uint32, int(size.sum()))
        self.edge[n + 1 : n + 1 + len(parts)] = end
        self.place.update(zip(parts, range(n, n + len(parts)), strict=True))

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edge): word k of these distinct words has ids[edge[k]:edge[k + 1]]."""
        if len(self.place) > REMEMBERED_RUNS:
            self._forget()
        runs = pc.ascii_rtrim(words, characters=string.punctuation)
        plain = pc.or_(pc.ascii_is_alpha(runs), pc.match_substring_regex(words, f"^[{_LETTERS}]+{_MARKS}$"))
        letters = pc.utf8_lower(runs.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(plain), characters=_LATIN).dictionary_encode()
        rest = [w if re.fullmatch(_MARKS, w) else f" {w}" for w in words.filter(pc.invert(plain)).to_pylist()]
        parts = [letters.dictionary.to_pylist(), marks.dictionary.to_pylist(), rest]
        if new := list(dict.fromkeys(p for p in chain.from_iterable(parts) if p not in self.place)):
            self._learn(new)
        first, second, own = (np.fromiter(map(self.place.__getitem__, p), np.int64, len(p)) for p in parts)
        plain = plain.to_numpy(zero_copy_only=False)
        number = np.zeros((len(words), 2), np.int64)
        number[plain, 0], number[plain, 1] = first[letters.indices.to_numpy()], second[marks.indices.to_numpy()]
        number[~plain, 0] = own
        start = self.edge[number].ravel()
        size = self.edge[number + 1].ravel() - start
        edge = bounds(size)
        return self.ids[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])], edge[::2]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's token ids, ended by id 0, cut at `capacity`.

    ids is BINARY, little-endian unsigned 32-bit. A null or empty text has the ending 0 alone. Repeated rows are
    cut one by one. The vocabulary's path must exist on every executor; None takes the installed one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary or default_vocabulary())
        for batch in chunks(batches, "text"):
            words, counts = split_words(batch.column("text"))
            coded = words.dictionary_encode()
            codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            flat, edge = encoder.encode(words)
            flat = np.append(flat, np.uint32(0))
            size = np.append(np.diff(edge), 1)
            first = edge.astype(np.int32)  # the last is the ending's
            ends = np.cumsum(counts) + np.arange(len(counts))
            full = np.full(len(codes) + len(counts), len(words), np.int32)
            inner = np.ones(len(full), bool)
            inner[ends] = False
            full[inner] = codes
            n = size[full]
            edge = bounds(n)
            stream = np.repeat((first[full] - edge[:-1]).astype(np.int32), n)  # int32: a chunk, or one text, has fewer tokens
            stream += np.arange(len(stream), dtype=np.int32)
            stream = flat[stream]
            doc_end = edge[ends + 1]
            tokens = np.diff(doc_end, prepend=0)
            pieces = -(-tokens // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(bounds(pieces)[:-1], pieces)
            start = piece * capacity
            length = np.minimum(capacity, tokens[owner] - start)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer((np.append((doc_end - tokens)[owner] + start, len(stream)) * 4).astype(np.int32)), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data], names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids binary")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest price of lengths (ascending) that fit together, and how often each is taken (any number of times).

    Rooms are filled in runs no longer than the least length, which depend on earlier runs only.
    """
    last, run = np.full(capacity + 1, -1), int(lengths[0])
    best = np.concatenate([np.full(capacity, -np.inf), np.zeros(capacity + 1)])  # rooms below 0 can't be had
    for start in range(run, capacity + 1, run):
        rooms = np.arange(start, min(start + run, capacity + 1))
        value = best[(rooms + capacity)[:, None] - lengths] + prices
        k = value.argmax(1)
        best[rooms + capacity], last[rooms] = value[np.arange(len(rooms)), k], k
    taken, room = np.zeros(len(lengths), np.int64), capacity
    while room >= run:
        k = last[room]
        taken[k] += 1
        room -= int(lengths[k])
    return float(best[-1]), taken


def fractional_packing(histogram: dict[int, int], capacity: int = CAPACITY, phases: int = 3, rate: float = 2.0) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """([(fractional number of sequences, {length: pieces in each})], lower bound on any packing's number of sequences).

    Multiplicative weights on the covering program: a length's price is in proportion to it and falls with
    exp(-rate * coverage), where coverage is the share of its pieces that the solution so far takes in. Each step
    takes the best configuration under the prices often enough to raise the coverage of its scarcest length by
    1 / phases, so that the solution is an average over that many passes; lengths that are covered leave the program.
    In the end every length is covered at least once. The bound is the best value of prices as a dual solution.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    asked = np.array([histogram[int(k)] for k in lengths], float)
    covered, solution = np.zeros(len(lengths)), {}
    bound = float((lengths * asked).sum()) / capacity
    while True:
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            return [(x, dict(c)) for c, x in solution.items()], bound
        prices = lengths[open_] / capacity * np.exp(-rate * covered[open_])
        value, taken = _knapsack(lengths[open_], prices, capacity)
        if len(open_) == len(lengths):
            bound = max(bound, float((prices * asked).sum()) / value)
        used = open_[taken > 0]
        each = np.minimum(taken[taken > 0], np.ceil(asked[used])).astype(np.int64)
        step = float((asked[used] / each).min()) / phases
        covered[used] += each * step / asked[used]
        name = tuple(zip(lengths[used].tolist(), each.tolist(), strict=True))
        solution[name] = solution.get(name, 0.0) + step


def _real(solution: list[tuple[float, dict[int, int]]], left: dict[int, int], capacity: int, grid: int, rest: float) -> list[list]:
    """Whole sequences from the fractional configurations over length classes, as best-fit groups; `left` shrinks.

    Configurations of fewer, longer pieces go first, since short pieces suit any gap. Each is taken as often as its
    number says, at least once, while its classes have pieces: of a class the most frequent length, and as the last
    piece the longest one that the room really left holds. Sequences with a wider gap than the configuration has are
    not taken; their pieces stay in `left`, and so does a share of `rest` of all tokens, to fill gaps with.
    """
    groups: list[list] = []
    tokens = sum(k * n for k, n in left.items())
    stop = rest * tokens
    members: dict[int, list[int]] = {}
    for k in left:
        members.setdefault(-(-k // grid), []).append(k)
    open_ = sorted(left)
    for x, contents in sorted(solution, key=lambda s: (sum(s[1].values()), -s[0], sorted(s[1].items()))):
        wanted = [c for c, n in sorted(contents.items(), reverse=True) for _ in range(n)]
        gap, times = capacity - grid * sum(wanted), max(1, int(x))
        while times and tokens > stop:
            chosen: dict[int, int] = {}
            room = capacity
            for c in wanted[:-1]:
                k = max((k for k in members.get(c, ()) if left[k] > chosen.get(k, 0)), key=lambda k: (left[k] // (chosen.get(k, 0) + 1), k), default=None)
                if k is not None:
                    chosen[k] = chosen.get(k, 0) + 1
                    room -= k
            at = bisect_left(open_, room + 1) - 1
            while at >= 0 and left[open_[at]] <= chosen.get(open_[at], 0):
                at -= 1
            if at >= 0:
                chosen[open_[at]] = chosen.get(open_[at], 0) + 1
                room -= open_[at]
            if not chosen or room > gap:
                break
            most = min(times, *(left[k] // n for k, n in chosen.items()))
            for k, n in chosen.items():
                left[k] -= n * most
                tokens -= k * n * most
                if not left[k]:
                    open_.pop(bisect_left(open_, k))
                    members[-(-k // grid)].remove(k)
            groups.append([room, most, chosen])
            times -= most
    return groups


#: Length classes of the program: lengths are rounded up to the finest grid that has no more.
CLASSES = 256
#: Share of the tokens that rounding leaves to best fit.
REST = 0.2


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rest: float = REST) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """([(number of sequences, {length: pieces in each})], lower bound on any packing's number of sequences).

    The configuration program is solved fractionally over all lengths, or, where they are more than CLASSES, over
    classes of lengths rounded up. Its configurations are rounded to whole sequences of real pieces (`_real`). Pieces
    that are left, few of each length, are placed best fit, largest first, in the gaps of planned sequences too. The plan
    covers the histogram exactly.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    total = float(sum(k * n for k, n in left.items())) / capacity
    grid = next((g for g in (1, 2, 4, 8) if capacity % g == 0 and len({-(-k // g) for k in left}) <= CLASSES), 1)
    classes: dict[int, int] = {}
    for k, n in left.items():
        classes[-(-k // grid)] = classes.get(-(-k // grid), 0) + n
    solution, part = fractional_packing(classes, capacity // grid, max(3, 1200 // max(1, len(classes))))
    groups = _real(solution, left, capacity, grid, rest)
    return _best_fit(left, capacity, groups), max(total, part) if grid == 1 else total


def _best_fit(histogram: dict[int, int], capacity: int, groups: list[list] | None = None) -> list[tuple[int, dict[int, int]]]:
    """Best fit, largest first, over equal sequences at a time; `groups` are begun ones: room, number of sequences, contents."""
    groups = groups if groups is not None else []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            fitting = [g for g in groups if g[0] >= length]
            if not fitting:
                each = min(n, capacity // length)
                groups.append([capacity - each * length, n // each, {length: each}])
                n -= n // each * each
                continue
            g = min(fitting, key=lambda g: g[0])
            each = min(g[0] // length, n)
            times = min(g[1], n // each)
            if times < g[1]:
                groups.append([g[0], g[1] - times, dict(g[2])])
                g[1] = times
            g[0] -= each * length
            g[2][length] = g[2].get(length, 0) + each
            n -= each * times
    return [(n, contents) for _, n, contents in groups]


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """`pieces` (doc_id, piece, length and any others) with sequence_id and offset.

    The pieces are stored first, each with a number of its own, since they are read three times; a length's pieces
    are dealt by it into groups of about `deal_rows`, so that equal rows spread as well and get places of their own.
    An empty table stays empty. The plan has at most some thousand rows for a capacity of 2048, whatever the corpus;
    it is joined by length and rank inside a small Arrow step.
    """
    names, number = pieces.columns, free_name("_number", pieces)
    pieces = written(pieces.withColumn(number, F.xxhash64(F.monotonically_increasing_id())))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    deal = F.pmod(number, F.lit(-(-max(histogram.values(), default=1) // deal_rows))).cast("int")
    counted = pieces.groupBy("length", deal.alias("deal")).agg(F.count("*").alias("n"))
    plan, _ = plan_packing(histogram, capacity)
    ranks: dict[int, list] = {}
    sequence, upto = 0, dict.fromkeys(histogram, 0)
    for times, contents in plan:
        offset = 0
        for length, each in sorted(contents.items(), reverse=True):
            ranks.setdefault(length, []).append((upto[length], each, sequence, offset))
            upto[length] += times * each
            offset += length * each
        sequence += times
    table = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in ranks.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, each, sequence, at = table.value[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                past = rank[rows] - first[k]
                sequence_id[rows] = sequence[k] + past // each[k]
                offset[rows] = at[k] + past % each[k] * length[rows]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence_id), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "deal").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("deal", deal).withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "deal"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).select(*names, "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != number)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of `docs`.

    With `with_ids` the token ids themselves go along; else only their checksum does, which keeps the shuffle narrow.
    Null and empty texts are one piece of the ending alone, very long ones are cut whole, repeated rows are packed one
    by one, rows without a doc_id like others, an empty table gives an empty result; other columns are not read.
    """
    pieces = token_pieces(docs, vocabulary, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return place_pieces(pieces if with_ids else pieces.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens): the packed sequences; each gathers at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"), F.sum("length").alias("n_tokens"))
