"""How much of a packing the configuration program decides, and what it costs in sequences."""

from collections import Counter

import pyarrow as pa
import pytest

from granary.llm import packing


@pytest.mark.parametrize("scale,most", [("sf0.01", 442), ("sf0.1", 4539)])
def test_program_places_most_pieces(spark, scale, most):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    histogram = {r["length"]: r["count"] for r in packing.token_pieces(docs).groupBy("length").count().collect()}
    plan, bound = packing.plan_packing(histogram)
    assert bound <= sum(times for times, _ in plan) <= most
    covered = Counter()
    for times, contents in plan:
        assert sum(k * n for k, n in contents.items()) <= 2048
        for k, n in contents.items():
            covered[k] += times * n
    assert covered == histogram
    left = dict(histogram)
    grid = next(g for g in (1, 2, 4, 8) if len({-(-k // g) for k in histogram}) <= packing.CLASSES)
    classes = Counter()
    for k, n in histogram.items():
        classes[-(-k // grid)] += n
    solution, _ = packing.fractional_packing(classes, 2048 // grid, max(3, 1200 // len(classes)))
    groups = packing._real(solution, left, 2048, grid, packing.REST)
    placed = sum(times * n for _, times, contents in groups for k, n in contents.items() if k < 2048)
    assert placed > 0.55 * sum(n for k, n in histogram.items() if k < 2048)
    assert all(packing.CAPACITY - room == sum(k * n for k, n in contents.items()) for room, _, contents in groups)


def test_program_decides_where_nothing_fits_whole():
    """Lengths that never fill a sequence keep the gaps of their configurations."""
    plan, bound = packing.plan_packing({700: 300, 900: 200})
    assert sum(times for times, _ in plan) == 250 and bound <= 250


def test_other_capacities():
    for capacity in (100, 7, 1000):
        histogram = {k: 1 + k % 3 for k in range(1, capacity + 1)}
        plan, bound = packing.plan_packing(histogram, capacity)
        covered = Counter()
        for times, contents in plan:
            assert sum(k * n for k, n in contents.items()) <= capacity
            for k, n in contents.items():
                covered[k] += times * n
        assert covered == histogram and bound <= sum(t for t, _ in plan) <= 1.05 * bound + 2


def test_words_share_runs_of_letters():
    encoder = packing.WordEncoder(packing.default_vocabulary())
    words = ["tree", "Tree,", "TREE!?", "tree's", "Été,", "été", "''", "!!", "a.b", "42", "É'", "<|endoftext|>"]
    ids, edge = encoder.encode(pa.array(words))
    for k, word in enumerate(words):
        assert ids[edge[k] : edge[k + 1]].tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids, word
    assert {"tree", "été"} < set(encoder.place)  # each once, whatever its case and marks
    assert not {"Tree,", "TREE!?", "Été,", " Tree,"} & set(encoder.place)
