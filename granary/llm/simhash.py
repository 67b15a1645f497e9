"""Near-duplicate documents by SimHash with meet-in-the-middle ball hashing.

Two fingerprints within two bits of each other have a common neighbour within one bit of both. Every distinct
fingerprint is therefore sent to itself and to all fingerprints one bit away; those that meet are linked. A meeting
place has at most as many fingerprints as there are bits and one, so that no group of copies makes a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import CHUNK_BYTES, LOWER, UPPER, bounds, chunks, discard, word_codes, written
from granary.llm.components import components

_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: For the corpus operator: words of a shingle and least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Words of the documents that one task compares, and how many documents of a larger group go to each of its tasks.
TASK_WORDS, HUBS = 1 << 19, 8


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included; fewer words make one run, none makes none."""
    parts = text.encode().translate(_LOW).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(parts) - words + 1)
    xxh = xxhash.xxh64_intdigest
    return np.array([xxh(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[len(parts) - n :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of the columns of hashes, 64 flags, lowest bit first: set in over half of the rows."""
    hashes = hashes.reshape(len(hashes), -1)
    raw = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8)
    total = np.zeros(raw.shape[1] * 8, np.int64)
    for s in range(0, len(raw), 255):
        total += np.add.reduce(np.unpackbits(raw[s : s + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * total > len(raw)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints as LONG, one row per row of `docs`; texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bits = [majority_bits(h) if len(h := shingle_hashes(t or "", words)) else np.zeros(64, bool) for t in batch.column("text").to_pylist()]
            fp = np.packbits(np.array(bits).reshape(-1, 64), axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def ball_links(points: DataFrame, bits: int, value: Column, node: str) -> DataFrame:
    """(a, b): nodes whose values are within two bits, linked over the least node met at each place.

    `points` has a row for each distinct value, and only the lowest `bits` bits are changed, so that higher ones can
    say which values may meet at all. All values that meet are within two bits of one another.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long") for k in range(bits)])
    sent = points.select(F.col(node).alias("a"), value.alias("_value"), F.explode(flips).alias("_flip")).select("a", F.col("_value").bitwiseXOR(F.col("_flip")).alias("_place"))
    met = sent.withColumn("b", F.min("a").over(Window.partitionBy("_place")))
    return met.where("a != b").select("a", "b").distinct()


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints as 16 hex digits, two bits apart or less linked.

    component_id is the smallest doc_id reachable. Equal fingerprints are one, whatever their number; null and empty
    texts share fingerprint 0, which links like any other. Rows may repeat; rows without a doc_id take part, and a
    component of theirs alone has none. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, words))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(ball_links(distinct, 64, F.col("fp"), "fp"))
    classed = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classed.join(least, "component").select("fp", "component_id")
    return rows.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scrambled(x: np.ndarray, turn: int) -> np.ndarray:
    """Each number's hash in this turn (splitmix64)."""
    x = x + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(shingle hashes text after text, number of each text's shingles, hash of each text's words, numbers of words).

    Shingles are hashed from the hashes of their words; fewer words make one shingle, none makes none.
    """
    codes, vocabulary, counts = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    stream, edge = known[codes] if len(codes) else np.zeros(0, np.uint64), bounds(counts)
    whole = [xxhash.xxh3_128_digest(stream[s:e].tobytes()) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    n = np.where(counts > 0, np.maximum(1, counts - words + 1), 0)
    at = np.repeat(edge[:-1] - bounds(n)[:-1], n) + np.arange(int(n.sum()))
    rolled, left = np.zeros(len(at), np.uint64), np.repeat(counts, n)
    for k in range(words):
        inside = left > k if (counts < words).any() else slice(None)
        rolled[inside] = rolled[inside] * np.uint64(0x9E3779B97F4A7C15) + stream[at[inside] + k]
    return _scrambled(rolled, 0), n, whole, counts


def minwise_bits(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """`size` bits for each set of hashes (laid end to end): each of two sets' bits differs with chance (1 - J) / 2.

    Every hash goes to one of `size` places in each turn, and a place takes the least hash of the first turn that
    reaches it; turns go on until all places of a set are taken, the later ones place by place. Its last bit counts.
    An empty set has zeros.
    """
    out, done = np.full((len(counts), size), np.iinfo(np.uint64).max), counts == 0
    flat, owner = out.reshape(-1), np.repeat(np.arange(len(counts)), counts)
    for turn in range(2 * size):
        if done.all():
            break
        if turn:
            keep = ~done[owner]
            hashes, owner = hashes[keep], owner[keep]
        drawn = _scrambled(hashes, turn + 1)
        place = owner * size + (turn - size if turn >= size else ((drawn >> np.uint64(32)) % np.uint64(size)).astype(np.int64))
        if turn:
            late = flat[place] == np.iinfo(np.uint64).max
            drawn, place = drawn[late], place[late]
        np.minimum.at(flat, place, _scrambled(drawn, 0) >> np.uint64(1))
        done = done | (out != np.iinfo(np.uint64).max).all(1)
    return (out & np.uint64(1)).astype(bool) & (counts > 0)[:, None]


def band_shape(n: int, similarity: float = SIMILARITY, recall: float = 0.95) -> tuple[int, int]:
    """(bits of a band, bands): unlike documents meet `n` others less than 0.3 times, like ones with chance `recall`.

    Two bands meet within two bits of each other. The chance is that at exactly the least similarity.
    """
    p = (1 - similarity) / 2
    for bits in range(24, 60):
        one = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
        bands = ceil(log(1 - recall) / log(1 - one))
        if n * bands * sum(comb(bits, k) for k in range(3)) / 2**bits < 0.3:
            break
    return bits, bands


def banded_prints(docs: DataFrame, bits: int, bands: int, words: int = SHINGLE) -> DataFrame:
    """(doc_id, bands ARRAY<LONG>, whole BINARY, n_words): minwise bits of the shingles, cut into bands, and a hash of the words.

    Texts without words have no bands and one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits)
        for batch in chunks(batches, "text"):
            hashes, n, whole, counts = chunk_shingles(batch.column("text"), words)
            values = minwise_bits(hashes, n, bits * bands).reshape(-1, bits) @ power
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)), pa.array(values[np.repeat(n > 0, bands)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own, pa.array(whole, pa.binary()), pa.array(counts.astype(np.int64))], names=["doc_id", "bands", "whole", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, bands array<long>, whole binary, n_words long")


def ball_hubs(values: DataFrame, bits: int) -> DataFrame:
    """(x, y): each of the distinct values of `value`, and the least one it meets where y < x, two bits apart or less.

    Only the lowest `bits` bits are changed, so that higher ones say which values may meet at all.
    """
    turned = lambda v, k: F.when(k < 0, v).otherwise(v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))))
    flips = F.array(*[F.lit(k).cast("tinyint") for k in range(-1, bits)])
    sent = values.select("value", F.explode(flips).alias("flip")).select(turned(F.col("value"), F.col("flip")).alias("place"), "flip")
    met = sent.withColumn("y", F.min(turned(F.col("place"), F.col("flip"))).over(Window.partitionBy("place")))
    return met.select(turned(F.col("place"), F.col("flip")).alias("x"), "y").where("y < x").distinct()


def _met(printed: DataFrame, bits: int, most: int) -> DataFrame:
    """(node, component) of documents joined by equal or close bands, compared or not; not of two with over `most` unlike bits."""
    points = printed.where("bands IS NOT NULL").select("doc_id", F.posexplode("bands").alias("band", "value"))
    points = written(points.select("doc_id", (F.shiftleft(F.col("band").cast("long"), bits) + F.col("value")).alias("value")))
    firsts = written(points.groupBy("value").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # values that several documents have, or that meet others, are few: stored, they are known to be when joins are planned
    shared = written(firsts.where("n > 1").select("value", "node"))
    same = points.join(shared, "value").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    hubs = written(ball_hubs(firsts.select("value"), bits))
    near = hubs.join(firsts.select(F.col("value").alias("x"), F.col("node").alias("a")), "x").join(firsts.select(F.col("value").alias("y"), F.col("node").alias("b")), "y").select("a", "b")
    found = components(same.unionByName(near))
    # most that meet by chance are two alone: those whose bits differ too much for the least similarity go
    pairs = found.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("a")).where("n = 2").select("component", "a")
    own = printed.where("bands IS NOT NULL").groupBy("doc_id").agg(F.min("bands").alias("bands"), F.count("*").alias("texts")).where("texts = 1")
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("bands").alias("bands_a")), "a").join(own.select(F.col("doc_id").alias("component"), F.col("bands").alias("bands_b")), "component")
    unlike = F.aggregate(F.zip_with("bands_a", "bands_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    found = written(found.join(both.where(unlike > most).select("component"), "component", "left_anti"))
    for table in (points, firsts, shared, hubs):
        discard(table)
    return found


def _links_within(words: int, least: float):
    """Joins documents of one task by their shingle sets; rows come sorted by task, and a task's rows fit in memory.

    A document that is in the task's largest group by the time of its turn is skipped: of two documents in unlike
    groups at the end, one at least was compared with all others of its task.
    """

    def found(hashes: np.ndarray, n: np.ndarray, task: np.ndarray, label: list[int]) -> Iterator[tuple[int, int]]:
        owner = np.repeat(np.arange(len(n)), n)
        key = _scrambled(hashes ^ task[owner].astype(np.uint64), 1)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
        key, owner = key[new], owner[new]
        size = np.bincount(owner, minlength=len(n))
        own, edge = np.argsort(owner, kind="stable"), bounds(size)
        run = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        stop = np.append(run[1:], len(key))
        which = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.zeros(0, np.int64)
        root = list(range(len(n)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        first: dict[int, int] = {}
        for k, name in enumerate(label):
            if name in first:
                root[k] = first[name]
            else:
                first[name] = k
        starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(n)).tolist(), strict=True):
            main = s
            for x in range(s, e):
                if x > s and top(x) == top(main):
                    continue
                mine = which[own[edge[x] : edge[x + 1]]]
                span = stop[mine] - run[mine]
                wide = span > 1
                if not wide.any():
                    continue
                at = np.repeat(run[mine[wide]] - bounds(span[wide])[:-1], span[wide]) + np.arange(int(span[wide].sum()))
                both = np.bincount(owner[at] - s, minlength=e - s)
                for y in (np.flatnonzero((both >= least * (size[x] + size[s:e] - both)) & (both > 0)) + s).tolist():
                    if (a := top(x)) != (b := top(y)):
                        root[max(a, b)] = min(a, b)
                        yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                hashes, n, _, _ = chunk_shingles(rows.column("text"), words)
                task = rows.column("task").to_numpy()
                pairs = list(found(hashes, n, task, list(zip(task.tolist(), rows.column("label").to_pylist(), strict=True))))
                ids = rows.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1)], names=["a", "b"])

        room = 0
        for batch in batches:
            held.append(batch)
            room += batch.nbytes
            if room > CHUNK_BYTES:
                rows = pa.Table.from_batches(held)
                task = rows.column("task").to_numpy()
                cut = len(task) - int((task[::-1] != task[-1]).argmax()) if task[0] != task[-1] else 0
                if cut:
                    yield from settled(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    room = sum(b.nbytes for b in held)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def _compared(members: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) found between documents of one task; `members` is (doc_id, task, label); rows of one label are joined already."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.join(members, "doc_id").select("task", "label", "doc_id", "text").repartition("task").sortWithinPartitions("task", "doc_id")
    return rows.mapInArrow(_links_within(words, similarity), f"a {kind}, b {kind}")


def near_duplicate_groups(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, shape: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, component_id) for documents in a group of near copies: `similarity` or more of their shingle sets.

    Ball hashing band by band (see `band_shape`; `shape` sets bits and bands) joins all documents that meet into
    candidate groups, without comparing them. Inside a candidate group any two documents are compared by their whole
    shingle sets, unless others join them already: groups of up to TASK_WORDS words in one task; larger ones in
    blocks together with a few common members first, after which blocks of what is not in the largest part meet all
    blocks. Equal texts but for case and spacing are one point with its smallest document. `doc_id` may be of any
    ordered type; rows of one doc_id count as one document, rows without one are left out, and texts without words are
    one group. A null text is empty; texts are taken whole; an empty table gives an empty result.
    """
    tables: list[DataFrame] = []

    def stored(df: DataFrame) -> DataFrame:
        tables.append(written(df))
        return tables[-1]

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits, bands = shape or band_shape(rows.count(), similarity)
    printed = stored(banded_prints(rows, bits, bands, words))
    heads = stored(printed.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"), F.max("n_words").alias("n_words")))
    p = (1 - similarity) / 2
    most = ceil(bits * bands * p + 5 * sqrt(bits * bands * p * (1 - p)))  # five standard errors over the mean
    met = _met(heads, bits, most)
    tables.append(met)
    met = met.withColumnRenamed("node", "doc_id").join(heads.groupBy("doc_id").agg(F.sum("n_words").alias("n_words")), "doc_id")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n).cast("int")
    task = lambda *of: F.xxhash64("component", *of)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = met.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_words") / TASK_WORDS)).cast("int").alias("blocks"))
    met = stored(met.join(blocks, "component").withColumn("block", deal(0, F.col("blocks"))))
    large = met.where("blocks > 1")
    common = large.groupBy("component", "blocks", deal(1, F.lit(HUBS)).alias("_part")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "doc_id"), "doc_id")).getField("doc_id").alias("doc_id"))
    common = common.withColumn("block", numbers(F.col("blocks"))).select("doc_id", task("block").alias("task"))
    # stored, so that its size is known before the join with the texts is planned: small ones need no shuffle of texts
    members = stored(met.select("doc_id", task("block").alias("task")).unionByName(common).distinct().withColumn("label", F.col("doc_id")))
    links = stored(_compared(members, rows, words, similarity))
    if large.take(1):
        known = stored(components(links))
        parts = large.join(known.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        sizes = parts.groupBy("component", "label").agg(F.struct(F.count("*").alias("n"), "label", F.sum("n_words").alias("n_words")).alias("s"))
        main = sizes.groupBy("component").agg(F.max("s").alias("most"), F.sum("s.n_words").alias("all"))
        main = main.select("component", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.n_words")) / TASK_WORDS).cast("int").alias("others")).where("others > 0")
        parts = stored(parts.join(main, "component"))
        rest = parts.where("label != main").withColumn("part", deal(3, F.col("others"))).withColumn("block", numbers(F.col("blocks")))
        every = parts.withColumn("part", numbers(F.col("others")))
        again = rest.select("doc_id", "label", task("part", "block").alias("task")).unionByName(every.select("doc_id", "label", task("part", "block").alias("task")))
        links = links.unionByName(stored(_compared(stored(again.distinct()), rows, words, similarity)))
    head = heads.select("whole", F.col("doc_id").alias("head"))
    copies = printed.join(head, "whole").where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    found = components(links.unionByName(copies))
    for table in tables:
        discard(table)
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without all but the smallest doc_id of each group of near copies.

    Rows without a doc_id stay, and so do all rows of a doc_id that stays; see `near_duplicate_groups` for the rest.
    """
    groups = near_duplicate_groups(docs, words, similarity)
    gone = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
