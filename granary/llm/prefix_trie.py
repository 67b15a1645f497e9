"""The prefix trie of conversations: who shares which first turns, and what sharing them saves.

A prefix is known by a polynomial hash of its turns, which is a running sum over a distributed order, so that no
conversation meets in one task. Nodes are groups of equal prefixes. Subtrees of at most LIMIT turns are dealt out
whole, and each task builds one level-order unary degree sequence (LOUDS) of its subtrees with label arrays in level
order; walking its levels backwards, `add.at` sums up members, leaves and saved characters. Nodes above those
subtrees, few by their weight, get the sums of the subtrees that hang from them and are merged as a trie of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import running
from granary.shared import Tables

#: Turns below a node (of each member, repeats counted) from which on it is an upper node, merged separately.
LIMIT = 1 << 15
#: Nodes that a task's subtrees have together, about; and upper nodes that are merged in one task.
SHARD_NODES, MERGE_NODES = 1 << 17, 1 << 17
#: conv_ids whose digits are joined before a node's are put together.
IDS = 4096

# four residues of 31 bits: a prefix has 124
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([1389796733, 1023728653, 1741932761, 612495811], np.uint64)
_KEY = ["depth", "k1", "k2"]
_LANES = ["s0", "s1", "s2", "s3"]
_TERMS = ["t0", "t1", "t2", "t3"]


def conversation_turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, place, x1, x2, chars): each turn's place in its conversation, from 1, its hash and its text's length.

    Turns go by `turn`, null first, and those of equal `turn` by their hash. A null role or text counts as empty;
    rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    placed = running(tables.write(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), "x1", "x2", "row"], {"place": None}, tables)
    return placed.select("conv_id", "place", "x1", "x2", "chars")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps (conv_id, depth, length, x1, x2, chars) and the conversations (conv_id, length) of unchanged turns."""
    own = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    return turns.join(own, "conv_id").withColumnRenamed("place", "depth"), own


def branched(turns: DataFrame, tables: Tables, group: int = 100, branches: int = 6) -> tuple[DataFrame, DataFrame]:
    """Steps and conversations where each conversation c takes over the first h turns of c - c % group in place of its own.

    h is crc32 of c's decimal digits modulo `branches`. A missing first conversation gives none, a short one all it has.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % branches).cast("long")
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({"h": h, "root": F.col("conv_id") - F.col("conv_id") % group})
    own = tables.write(own)
    roots = own.select(F.col("conv_id").alias("root"), F.col("n").alias("n_root"))
    known = own.join(roots, "root", "left").withColumn("taken", F.least("h", F.coalesce("n_root", F.lit(0))))
    known = tables.write(known.select("conv_id", "root", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    columns = ["conv_id", "depth", "length", "x1", "x2", "chars"]
    mine = turns.join(known.drop("root"), "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
    first = turns.where((F.col("place") < branches) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "root")
    theirs = first.join(known, "root").where("place <= taken").withColumnRenamed("place", "depth")
    return mine.select(columns).unionByName(theirs.select(columns)), known.select("conv_id", "length")


def _powers(base: np.uint64, exponent: np.ndarray, prime: np.uint64) -> np.ndarray:
    out, square, rest = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * square % prime, out)
        square, rest = square * square % prime, rest >> np.uint64(1)
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each turn adds to its prefixes' hashes: a part of its own hash times a base to the power of its depth."""
    for batch in batches:
        x1, x2, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "x2", "depth"))
        x1, x2 = x1.astype(np.int64).view(np.uint64), x2.astype(np.int64).view(np.uint64)
        parts = [x & np.uint64(0xFFFFFFFF) if low else x >> np.uint64(32) for x in (x1, x2) for low in (True, False)]
        terms = [pa.array(((x % p + np.uint64(1)) * _powers(b, depth, p) % p).astype(np.int64)) for x, b, p in zip(parts, _BASES, _PRIMES, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "length", "chars")), *terms], names=["conv_id", "depth", "length", "chars", *_TERMS])


def prefixes(steps: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, depth, length, chars, k1, k2, p1, p2): for each turn its prefix's hash and the hash of that before it."""
    kinds = "conv_id long, depth long, length long, chars long, " + ", ".join(f"{t} long" for t in _TERMS)
    summed = running(tables.write(steps.mapInArrow(_terms, kinds)), ["conv_id"], ["depth"], dict(zip(_LANES, _TERMS, strict=True)), tables)
    pair = lambda v: [F.shiftleft(v[a] % int(_PRIMES[a]), 31).bitwiseOR(v[b] % int(_PRIMES[b])) for a, b in ((0, 1), (2, 3))]
    key, parent = pair([F.col(s) for s in _LANES]), pair([F.col(s) - F.col(t) for s, t in zip(_LANES, _TERMS, strict=True)])
    return summed.select("conv_id", "depth", "length", "chars", *(c.alias(n) for c, n in zip([*key, *parent], ["k1", "k2", "p1", "p2"], strict=True)))


class Louds:
    """A forest below one root: bits with a one for each child and a zero after each node, in level order."""

    def __init__(self, level: np.ndarray, key: np.ndarray, parent: np.ndarray):
        """level: from 1 at the forest's tops; key and parent: (n, 3) arrays; tops' parents are not in `key`."""
        n = len(level)
        both = np.concatenate([key, parent])
        by = np.lexsort(both.T)
        new = np.concatenate([[False], (both[by[1:]] != both[by[:-1]]).any(1)])
        rank = np.empty(2 * n, np.int64)
        rank[by] = np.cumsum(new)
        node = np.full(int(rank.max(initial=-1)) + 1, -1)
        node[rank[:n]] = np.arange(n)
        above = np.where(level > 1, node[rank[n:]], -1)  # a node's place in the input
        by = np.argsort(level, kind="stable")
        self.edges = np.searchsorted(level[by], np.arange(1, int(level.max(initial=0)) + 2)) + 1
        self.order, place = np.empty(n, np.int64), np.zeros(n + 1, np.int64)  # place[-1]: the root's
        for lo, hi in zip(self.edges[:-1], self.edges[1:], strict=True):
            own = by[lo - 1 : hi - 1]
            own = own[np.lexsort((key[own, 2], key[own, 1], place[above[own]]))]
            place[own] = np.arange(lo, hi)
            self.order[lo - 1 : hi - 1] = own
        self.children = np.bincount(place[above], minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(self.children) + np.arange(n + 1)] = False

    def parents(self) -> np.ndarray:
        """The place of each node's parent: zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def rollup(self, ends: np.ndarray, chars: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, ...]:
        """Members, children, leaves and saved characters by place, from what nodes have of their own and from elsewhere."""
        above = self.parents()
        children = self.children + np.concatenate([[0], children[self.order]])
        members, leaves, saved, chars = (np.concatenate([[0], x[self.order]]) for x in (ends, leaves, saved, chars))
        leaves = leaves + (children == 0)
        for lo, hi in zip(self.edges[-2::-1], self.edges[:0:-1], strict=True):  # deepest level first
            saved[lo:hi] += (members[lo:hi] - 1) * chars[lo:hi]
            for x in (members, leaves, saved):
                np.add.at(x, above[lo - 1 : hi - 1], x[lo:hi])
        return members, children, leaves, saved


_OUT = ["conv_id", *_KEY, "p1", "p2", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = ", ".join(f"{c} long" for c in _OUT)
_OWN = ["conv_id", *_KEY, "p1", "p2", "top", "ends", "chars", "more_children", "more_leaves", "more_saved"]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rolls up all nodes of a partition; `top` is the depth of the subtree's top."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    col = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for b in held]) for c in _OWN}
    trie = Louds(col["depth"] - col["top"] + 1, np.stack([col[c] for c in _KEY], 1), np.stack([col["depth"] - 1, col["p1"], col["p2"]], 1))
    members, children, leaves, saved = (x[1:] for x in trie.rollup(col["ends"], col["chars"], col["more_children"], col["more_leaves"], col["more_saved"]))
    own = {c: col[c][trie.order] for c in ("conv_id", *_KEY, "p1", "p2")}
    above = trie.parents()
    least = pa.array(np.concatenate([[0], own["conv_id"]])[above], mask=above == 0)
    yield pa.RecordBatch.from_arrays([*(pa.array(own[c]) for c in own), least, pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved)], names=_OUT)


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out &= F.col(a) == F.col(b)
    return out


def _upper(nodes: DataFrame, below: DataFrame, tables: Tables) -> DataFrame:
    """Upper nodes with their sums: `below` (parent's key, sums of what hangs from it) has one row for each lower top."""
    sums = ["more_children", "more_leaves", "more_saved", "more_members"]
    given = below.groupBy("depth", "k1", "k2").agg(F.count("*").alias(sums[0]), *[F.sum(c).alias(c) for c in sums[1:]])
    nodes = tables.write(nodes.join(given, _KEY, "left").na.fill(0, sums).withColumn("ends", F.col("ends") + F.col("more_members")).drop("more_members").withColumn("top", F.lit(0).cast("long")))
    done = []
    while nodes.count() > MERGE_NODES:  # the deepest level has nothing of its own below it and hands its sums up
        deepest = nodes.agg(F.max("depth")).first()[0]
        level = nodes.where(F.col("depth") == deepest).select(
            "conv_id", *_KEY, "p1", "p2", F.col("ends").alias("n_convs"), F.col("more_children").alias("n_children"), F.when(F.col("more_children") == 0, 1).otherwise(F.col("more_leaves")).cast("long").alias("n_leaves"), (F.col("more_saved") + (F.col("ends") - 1) * F.col("chars")).alias("saved_tokens")
        )
        level = tables.write(level)
        done.append(level)
        up = level.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"), F.sum("n_convs").alias("_m"))
        rest = nodes.where(F.col("depth") < deepest).join(up, _KEY, "left").na.fill(0, ["_c", "_l", "_s", "_m"])
        nodes = tables.write(rest.withColumns({"more_children": F.col("more_children") + F.col("_c"), "more_leaves": F.col("more_leaves") + F.col("_l"), "more_saved": F.col("more_saved") + F.col("_s"), "ends": F.col("ends") + F.col("_m")}).drop("_c", "_l", "_s", "_m"))
    merged = nodes.select(_OWN).coalesce(1).mapInArrow(_forest, _SCHEMA)
    for level in done:
        above = nodes.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.col("conv_id").alias("parent_conv_id"))
        for other in done:
            above = above.unionByName(other.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.col("conv_id").alias("parent_conv_id")))
        linked = level.join(above, (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2")), "left")
        merged = merged.unionByName(linked.select(_OUT))
    return merged


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end: their ids in order, joined by commas.

    Ids are put together by ranges, and a node's ranges are streamed in order through its digest, which is serial.
    """
    part = ends.groupBy(*_KEY, F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key != now:
                    if sha:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(done)
            done = []
        if sha:
            yield _rows([(*now, sha.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.int64() if k < 3 else pa.string()) for k in range(4)], names=[*_KEY, "ends_sha256"])

    return part.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(steps: DataFrame, conversations: DataFrame, tables: Tables, limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix, the empty one included: conv_id (smallest member), depth, k1, k2, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    steps: (conv_id, depth, length, x1, x2, chars), conversations: (conv_id, length), of which those without a turn are
    members of the empty prefix alone. Without any conversation the result is empty. `limit` splits the work and
    doesn't change the result.
    """
    spark = steps.sparkSession
    paths = prefixes(steps, tables)
    ended = F.col("depth") == F.col("length")
    nodes = tables.write(paths.groupBy(_KEY).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.count_if(ended).alias("ends"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight")))
    zero = [F.lit(0).cast("long").alias(c) for c in (*_KEY, "p1", "p2")]
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count_if(F.col("length") == 0).alias("ends")).where("conv_id IS NOT NULL").select(*zero, "conv_id", F.lit(0).cast("long").alias("chars"), "ends")
    upper = nodes.where(F.col("weight") > limit).drop("weight")
    # a conversation's path leaves the upper nodes at one place, the top of the subtree that holds the rest of it
    left = paths.join(upper.select(_KEY), _KEY).groupBy("conv_id").agg(F.max("depth").alias("_upper"))
    tops = paths.join(left, "conv_id", "left").where(F.col("depth") == F.coalesce("_upper", F.lit(0)) + 1).select("conv_id", F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("depth").alias("top"))
    lower = nodes.where(F.col("weight") <= limit).join(tops, "conv_id")
    parts = max(1, -(-nodes.count() // SHARD_NODES))
    none = {c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
    lower = lower.withColumns(none).select(*_OWN, "s1", "s2").repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "s1", "s2")
    lower = tables.write(lower.drop("s1", "s2").mapInArrow(_forest, _SCHEMA))
    hanging = lower.where("parent_conv_id IS NULL").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"), F.col("n_convs").alias("more_members"))
    high = tables.write(_upper(root.unionByName(upper), hanging, tables))
    holders = high.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.col("conv_id").alias("_holder"))
    inner = lower.where("parent_conv_id IS NOT NULL")
    outer = lower.where("parent_conv_id IS NULL").join(holders, (F.col("depth") - 1 == F.col("_depth")) & _same(["p1", "p2"], ["_k1", "_k2"])).withColumn("parent_conv_id", F.col("_holder"))
    every = inner.unionByName(outer.select(_OUT)).unionByName(high.select(_OUT)).drop("p1", "p2")
    ends = paths.where(ended).select(*_KEY, "conv_id").unionByName(conversations.where("length = 0").select(*zero[:3], "conv_id"))
    out = every.join(_end_digests(ends), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return tables.keep(out)


def branched_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`prefix_trie` of conversations that take over the first turns of their group's first one (`branched`).

    Turns' ties and nulls are those of `conversation_turns`; repeated rows are turns of their own; texts of any length
    are read whole; other columns are not read; an empty table gives an empty result.
    """
    tables = Tables(conversations.sparkSession)
    steps, own = branched(conversation_turns(conversations, tables), tables)
    return prefix_trie(steps, own, tables, limit)


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`prefix_trie` of conversations as they are."""
    tables = Tables(conversations.sparkSession)
    steps, own = as_they_are(conversation_turns(conversations, tables))
    return prefix_trie(steps, own, tables, limit)


TRIE_SQL = """
WITH RECURSIVE digits AS (SELECT conv_id, conv_id::VARCHAR AS b FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (
  SELECT conv_id, b, 0 AS pos, 4294967295::UBIGINT AS c FROM digits
  UNION ALL
  SELECT conv_id, b, pos + 1, list_reduce([xor(c, ascii(substr(b, pos + 1, 1))::UBIGINT)] || range(8)::UBIGINT[], lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))
  FROM crc WHERE pos < length(b)),
h AS (SELECT conv_id, (xor(c, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM crc WHERE pos = length(b)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT own.conv_id, coalesce(first.l[:h], []) || own.l[h + 1:] AS l FROM own JOIN h USING (conv_id) LEFT JOIN own first ON first.conv_id = own.conv_id - own.conv_id % 100),
path AS (SELECT conv_id, len(l) AS n, unnest(range(len(l) + 1)) AS depth, l FROM built),
node AS (SELECT conv_id, n, depth, md5(l[:depth]::VARCHAR) AS k, CASE WHEN depth > 0 THEN md5(l[:depth - 1]::VARCHAR) END AS p, CASE WHEN depth > 0 THEN length(l[depth].t) ELSE 0 END AS chars FROM path),
per AS (SELECT depth, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM node GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, p AS k, count(*) AS n_children FROM per WHERE depth > 0 GROUP BY 1, 2),
own_sums AS (SELECT per.*, coalesce(n_children, 0) AS n_children, (coalesce(n_children, 0) = 0)::BIGINT AS leaf, (n_convs - 1) * chars AS saved FROM per LEFT JOIN kids USING (depth, k)),
up AS (SELECT depth AS d, k AS kk, p AS pp, leaf, saved FROM own_sums
  UNION ALL SELECT o.depth, o.k, o.p, u.leaf, u.saved FROM up u JOIN own_sums o ON o.depth = u.d - 1 AND o.k = u.pp),
total AS (SELECT d AS depth, kk AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1, 2)
SELECT o.conv_id, o.depth, above.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256
FROM own_sums o JOIN total USING (depth, k) LEFT JOIN per above ON above.depth = o.depth - 1 AND above.k = o.p"""
