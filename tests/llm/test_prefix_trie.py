"""The prefix trie against brute force: every limit gives the same nodes, and LOUDS bits tell the tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, place int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def nodes(built):
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, out = defaultdict(list), []
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[p]) or 1
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(sums[k][1] for k in kids[p])
        sums[p] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 260), *range(400, 470), 705, 1000, 1001, 1002]:  # 705: no first conversation
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            hot = rng.random() < 0.6
            rows.append((c, t, rng.choice(["user", "assistant"]) if not hot else "user", "hot" if hot else rng.choice(["é", "ab", "abc", None, ""])))
    rows += [(150, None, None, "first"), (3, 100, "user", "x" * 50_000), (3, 101, None, None), (None, 1, "user", "nobody's")]
    rows += [(1003, t, "user", f"turn {t}") for t in range(40)] + [(1004, t, "user", f"turn {t}") for t in range(40)]  # long ones
    return rows


@pytest.mark.parametrize("limit,merge", [(1 << 15, 1 << 17), (40, 1 << 17), (3, 20)])
def test_trie_equals_brute_force(spark, conversations, monkeypatch, limit, merge):
    monkeypatch.setattr(prefix_trie, "MERGE_NODES", merge)  # levels of upper nodes are merged one by one beyond it
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in conversations], SCHEMA).repartition(3)
    got = prefix_trie.branched_trie(table, limit)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == nodes(rebuilt(conversations))


def test_trie_of_unchanged_conversations(spark, conversations):
    plain = {}
    for c, turn, role, text in conversations:
        if c is not None:
            plain.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in conversations], SCHEMA)
    got = prefix_trie.conversation_trie(table).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == nodes({c: [t[2:] for t in sorted(x)] for c, x in plain.items()})


def test_repeated_turns_and_nothing(spark):
    table = spark.createDataFrame([(1, None, "user", "a", 1, "x", 2)] * 3 + [(2, None, "user", "a", 1, "x", 2)] * 3, SCHEMA)
    rows = sorted(map(tuple, prefix_trie.conversation_trie(table).select("depth", "conv_id", "n_convs", "saved_tokens").collect()))
    assert rows == [(0, 1, 2, 3), (1, 1, 2, 3), (2, 1, 2, 2), (3, 1, 2, 1)]
    assert prefix_trie.branched_trie(table.limit(0)).count() == 0
    assert prefix_trie.branched_trie(table.withColumn("conv_id", table["depth"] * None)).count() == 0


def test_many_ends_of_one_node(spark):
    """Ids of one node's ends go by number, over several ranges."""
    ids = [*range(-10, 9000, 3), 123456789]
    table = spark.createDataFrame([(c, 1, "user", "same", 1, "x", 2) for c in ids], SCHEMA)
    got = {r["depth"]: r for r in prefix_trie.conversation_trie(table).collect()}
    assert got[1]["n_convs"] == len(ids) and got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_louds_bits():
    """A root with two tops, of which the first has two children: 11 0 11 0 0 0 0 in level order, and its parents."""
    key = np.array([[1, 5, 0], [2, 9, 0], [1, 7, 0], [2, 8, 0]])
    trie = prefix_trie.Louds(key[:, 0], key, np.array([[0, 1, 1], [1, 5, 0], [0, 2, 2], [1, 5, 0]]))
    assert "".join(map(str, trie.bits.astype(int))) == "110110000"
    assert trie.order.tolist() == [0, 2, 3, 1] and trie.parents().tolist() == [0, 0, 1, 1]
    zero = np.zeros(4, np.int64)
    members, children, leaves, saved = trie.rollup(np.array([1, 2, 3, 4]), np.array([10, 1, 10, 1]), zero, zero, zero)
    assert members.tolist() == [10, 7, 3, 4, 2] and children.tolist() == [2, 2, 0, 0, 0] and leaves.tolist() == [3, 2, 1, 1, 1]
    assert saved[1:].tolist() == [60 + 3 + 1, 20, 3, 1]
