"""Ranked search for texts: inverted shards of documents, read by WAND with per-term maximum impacts.

A task turns the documents that it reads into shards: postings of the searched terms, by term and document. Document
frequencies and lengths are sums over shards. Then each shard is searched by the texts of a block together: cursors
of a text's terms stand in document order, the pivot is the first document at which the maximum impacts of the
cursors up to there reach the text's heap threshold, and everything before it is skipped. A task keeps its heaps
from shard to shard, and the tasks' heaps are merged by rank. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import LOWER, UPPER, chunks, discard, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Searched texts that one pass over the documents takes, and the bytes of all of them; more texts take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Postings of a shard; one document's are never parted.
SHARD_POSTINGS = 1 << 19
#: Cursors that move together: texts times their distinct terms.
CURSORS = 1 << 14
_NO_ID = (1 << 63) - 1  # stands for a document without an id, after all others

# by byte: white space unless it belongs to a term, with A-Z lower-cased
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def text_terms(text: str | None) -> list[str]:
    return [t for t in (text or "").encode().translate(_FOLD).decode().split(" ") if t]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and each text's number of terms."""
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    plain = pa.concat_arrays([plain]) if plain.offset else plain
    _, offsets, data = plain.buffers()
    folded = pa.py_buffer(data.to_pybytes().translate(_FOLD)) if data else pa.py_buffer(b"")
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(plain), offsets, folded, offset=plain.offset))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists))


_SHARD = "n_docs long, n_terms long, doc_id array<long>, length array<long>, term array<int>, df array<int>, doc array<int>, tf array<int>"


def index_shards(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Inverted shards of (doc_id, text) over the terms of `vocabulary`, one row each.

    n_docs and n_terms count all documents that have a term, and their terms; doc_id and length list those with a
    term of the vocabulary, by doc_id, nulls last; term and df list the terms found (places in the vocabulary) and
    their number of postings; doc (place in doc_id) and tf are the postings, by term and document.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        parts: list[tuple[np.ndarray, ...]] = []
        held, n_docs, n_terms = 0, 0, 0

        def shard() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            ids, lengths, term, tf = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
            doc = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc = place[doc]
            by = np.lexsort((doc, term))
            terms, df = np.unique(term, return_counts=True)
            cells = [[n_docs], [n_terms], [ids[order]], [lengths[order]], [terms.astype(np.int32)], [df.astype(np.int32)], [doc[by].astype(np.int32)], [tf[by].astype(np.int32)]]
            names = [x.split()[0] for x in _SHARD.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

        for batch in chunks(batches, "text"):
            flat, lengths = _split(batch.column("text"))
            n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
            coded = flat.dictionary_encode()
            known_as = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known_as[coded.indices.to_numpy(zero_copy_only=False)] if len(coded.dictionary) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)[term >= 0]
            key, tf = np.unique(doc * len(vocabulary) + term[term >= 0], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            own = np.unique(doc)
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            parts.append((ids[own], lengths[own].astype(np.int64), term, np.searchsorted(own, doc), tf))
            held += len(tf)
            if held >= SHARD_POSTINGS:
                yield shard()
                parts, held, n_docs, n_terms = [], 0, 0, 0
        if parts:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(build, _SHARD)


class Heaps:
    """The `k` best (score, doc_id) of each text; of equal scores the smaller doc_id is better."""

    def __init__(self, texts: int, k: int):
        self.score, self.doc = np.zeros((texts, k), np.int64), np.full((texts, k), _NO_ID, np.int64)
        self.least = np.ones(texts, np.int64)  # a score that a document must reach

    def push(self, text: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """One document for each of several texts, where it is better than the worst that is held."""
        worst = np.argmin(self.score[text], axis=1)
        low = self.score[text, worst]
        tied = np.where(self.score[text] == low[:, None], self.doc[text], np.iinfo(np.int64).min)  # of the worst, the largest id goes
        worst = np.argmax(tied, axis=1)
        better = (score > low) | (score == low) & (score > 0) & (doc < self.doc[text, worst])
        text, worst = text[better], worst[better]
        self.score[text, worst], self.doc[text, worst] = score[better], doc[better]
        self.least[text] = np.maximum(1, self.score[text].min(axis=1))


def wand(heaps: Heaps, texts: np.ndarray, terms: np.ndarray, times: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, impact: np.ndarray, most: np.ndarray, ids: np.ndarray) -> int:
    """Searches one shard for several texts at once; gives the number of documents scored.

    terms (places in the shard's terms, or the number of terms for none) and times have a row for each text; first,
    last and most describe each term's postings and maximum impact, with a row for "none" at the end. Heaps change.
    """
    n, scored = len(ids), 0
    at = first[terms]
    now = np.where(at < last[terms], doc[np.minimum(at, len(doc) - 1)], n)
    bound = times * most[terms]
    keys = np.repeat(np.arange(len(first) - 1), (last - first)[:-1]) * (n + 1) + doc  # ascending: by term, then document
    while len(texts):
        order = np.argsort(now, axis=1)
        reached = np.cumsum(np.take_along_axis(bound, order, 1), axis=1) >= heaps.least[texts][:, None]
        column = order[np.arange(len(texts)), np.argmax(reached, axis=1)]
        pivot = np.where(reached[:, -1], now[np.arange(len(texts)), column], n)
        open_ = pivot < n
        if not open_.all():
            texts, terms, times, at, now, bound, pivot = (x[open_] for x in (texts, terms, times, at, now, bound, pivot))
            if not len(texts):
                break
        behind = now < pivot[:, None]  # none of these documents can reach the threshold
        if behind.any():
            row, col = np.nonzero(behind)
            term = terms[row, col]
            to = np.searchsorted(keys, term * (n + 1) + pivot[row])
            at[row, col] = to
            now[row, col] = np.where(to < last[term], doc[np.minimum(to, len(doc) - 1)], n)
        row, col = np.nonzero(now == pivot[:, None])
        here = at[row, col]
        score = np.zeros(len(texts), np.int64)
        np.add.at(score, row, times[row, col] * impact[here])
        heaps.push(texts, score, ids[pivot])
        scored += len(texts)
        here = here + 1
        at[row, col] = here
        now[row, col] = np.where(here < last[terms[row, col]], doc[np.minimum(here, len(doc) - 1)], n)
    return scored


def search_shards(shards: DataFrame, items: list[tuple[int, list[str]]], vocabulary: list[str], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(text, doc_id, score): what is left in the tasks' heaps; text is a place in `items`."""
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = [Counter(place[t] for t in own) for _, own in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(counted), k)
        blocks, open_, by_width = [], [], sorted(range(len(counted)), key=lambda i: len(counted[i]))
        for i in by_width:
            if open_ and (len(open_) + 1) * len(counted[i]) > CURSORS:
                blocks, open_ = [*blocks, open_], []
            open_.append(i)
        blocks.append(open_)
        for batch in batches:
            for b in range(batch.num_rows):
                ids, length, term, df, doc, tf = (batch.column(c)[b].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "length", "term", "df", "doc", "tf"))
                if not len(doc):
                    continue
                last = np.cumsum(df)
                owner = np.repeat(np.arange(len(term)), df)
                grown = 25 + (75 * length * n_docs) // n_terms
                impact = weight[term][owner] * ((1_000_000_000 * tf) // (1000 * tf + 8 * grown[doc]))
                most = np.append(np.maximum.reduceat(impact, last - df), 0)
                first, last = np.append(last - df, len(doc)), np.append(last, len(doc))
                where = np.full(len(vocabulary) + 1, len(term))
                where[term] = np.arange(len(term))
                for block in blocks:
                    width = max((len(counted[i]) for i in block), default=0)
                    if width:
                        terms, times = np.full((len(block), width), len(vocabulary)), np.zeros((len(block), width), np.int64)
                        for r, i in enumerate(block):
                            terms[r, : len(counted[i])], times[r, : len(counted[i])] = list(counted[i]), list(counted[i].values())
                        wand(heaps, np.array(block), where[terms], times, first, last, doc, impact, most, ids)
        text, slot = np.nonzero(heaps.score > 0)
        found = heaps.doc[text, slot]
        yield pa.RecordBatch.from_arrays([pa.array(text.astype(np.int32)), pa.array(found, mask=found == _NO_ID), pa.array(heaps.score[text, slot])], names=["text", "doc_id", "score"])

    return shards.mapInArrow(search, "text int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        terms = text_terms(r["text"])
        if terms:
            block.append((r["item_id"], terms))
            size += len(r["text"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` best documents with a score above 0.

    Equal scores go by doc_id, rows without one last. Rows of `docs` count one by one: repeated rows and doc_ids each
    hold a rank. Each row of `items` is searched for by itself, and one without a term (a null or empty text) gives no
    row; so does an empty table of either kind. Texts of any length are read whole; other columns are not read.
    Items come to the driver in blocks of BLOCK_ITEMS rows or BLOCK_BYTES at most, and each block is one pass over the
    documents, whose terms outside the block are counted and let go.
    """
    spark = docs.sparkSession
    out = [_search_block(spark, docs, block, k) for block in _blocks(items)]
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _search_block(spark: SparkSession, docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    vocabulary = sorted({t for _, own in block for t in own})
    shards = written(index_shards(docs, vocabulary))
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    held = np.zeros(len(vocabulary), np.int64)
    for r in shards.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df")).collect():  # a row for each term of the block
        held[r[0]] = r[1]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in held], np.int64)
    found = search_shards(shards, block, vocabulary, weight, n_docs, max(1, n_terms), k)
    best = Window.partitionBy("text").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    discard(shards)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "text int, item_id long")
    return ranked.join(names, "text").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
size AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
post AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, whole GROUP BY term, docs),
item AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
score AS (
  SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN w USING (term) JOIN post USING (term) JOIN size USING (r), whole GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= {TOP}"""
