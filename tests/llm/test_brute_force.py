"""Operators that SQL cannot express (or not soon enough), against brute force on the smallest tables."""

import bisect
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from granary.llm import components, embeddings, language_model, licenses, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, urls
from granary.llm import queries as llm
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def run(spark, name):
    return llm.queries()[name](spark, SF_DIR).collect()


def reach(nodes, links):
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            least[n] = least[least[n]]
            n = least[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(packing.default_vocabulary()), defaultdict(dict)
    rows = run(spark, "op2_best_fit_packing")
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert len(own) == -(-len(ids) // 2048)
        for k in range(len(own)):
            part = ids[k * 2048 : (k + 1) * 2048]
            assert (own[k]["start"], own[k]["length"], own[k]["ids_crc32"]) == (k * 2048, len(part), zlib.crc32(part.tobytes()))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []
    for length in sorted((r["length"] for r in rows), reverse=True):  # best fit, largest first
        k = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 2048) - length)
    assert len(sequences) <= len(rooms)


def test_plan_covers_and_bounds():
    histogram = {700: 30, 683: 31, 400: 7, 1400: 11, 2048: 3, 1: 5}
    plan, bound = packing.plan_packing(histogram)
    got = Counter()
    for times, contents in plan:
        assert sum(k * n for k, n in contents.items()) <= 2048
        for k, n in contents.items():
            got[k] += times * n
    assert got == histogram
    assert bound <= sum(t for t, _ in plan) <= 46  # 45 are needed: 61 pieces go by twos, 11 and 3 alone
    assert packing.plan_packing({}) == ([], 0.0)


def test_fractional_packing_covers_and_approaches_the_bound():
    histogram = {900: 4000, 700: 3000, 600: 5000, 248: 2000, 100: 900}
    solution, bound = packing.fractional_packing(histogram, phases=40)
    covered = Counter()
    for x, contents in solution:
        assert sum(k * n for k, n in contents.items()) <= 2048
        for k, n in contents.items():
            covered[k] += x * n
    assert all(covered[k] >= n * (1 - 1e-6) for k, n in histogram.items())
    assert bound <= sum(x for x, _ in solution) <= 1.1 * bound
    plan, least = packing.plan_packing(histogram)
    assert sum(t for t, _ in plan) <= 1.02 * least


def test_tokens_of_odd_words_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["x<|endoftext|>y", "<|startoftext|> Hello <|endoftext|>", "a <|ENDOFTEXT|> b<|endoftext|>", "<|endoftext|><|endoftext|>.", "Don't stop... (876) É.b naïve, x-y İstanbul e\u0301\u00a0f", "\u4f60\u597d <| endoftext |>"]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]


def test_packed_sequences_round_trip(spark):
    frame = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "x " * 3000), (3, "")], "doc_id long, text string")
    whole = packing.sequences(packing.pack(frame)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 8192 for r in whole)
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in packing.pack(frame).collect())


def test_quality_rule_counts(spark, docs):
    for r in run(spark, "op4_quality_rules"):
        text = docs[r["doc_id"]]["text"] or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if often[w] > 1:
                covered |= {k, k + 1, k + 2}
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += line in seen and bool(WORD.search(line))
            seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["kept"] and failed)


def test_quality_rules_keep_good_documents(spark):
    verdict = {r["doc_id"]: r for r in run(spark, "op4_quality_rules")}
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()]
    passed = [i for i in good if not verdict[i]["base_failed"]]
    assert sum(verdict[i]["kept"] for i in passed) >= 0.9 * len(passed)


def test_viterbi_is_the_best_labelling():
    draw = np.random.default_rng(3)
    counts = np.array([1, 5, 0, 7])
    emission, transition = draw.normal(size=13), draw.normal(size=(2, 2))
    got, at = quality_rules.viterbi(emission, counts, transition), 0
    for n in counts:
        value = lambda y: sum(emission[at + k] * y[k] for k in range(n)) + sum(transition[y[k - 1], y[k]] for k in range(1, n))  # noqa: B023, E731
        best = max(value([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert value(got[at : at + n].tolist()) == pytest.approx(best)
        at += n


def test_line_dedup_stream(spark, docs):
    key = lambda line: line.strip("\x20\t\n\x0b\x0c\r").translate(LOW)
    owners = defaultdict(set)
    for i, r in docs.items():
        for line in (r["text"] or "").split("\n"):
            owners[key(line)].add(i)
    for r in run(spark, "op5_line_dedup"):
        lines = (docs[r["doc_id"]]["text"] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(owners[key(x)]) > 1 and min(owners[key(x)]) != r["doc_id"])]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_mixing(spark, docs):
    rows = run(spark, "op6_source_mixing")
    sizes = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    total, taken = Counter(), Counter()
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        total[source] += r["size"]
        taken[source] += r["taken"]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while open_:
        line = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * line > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * line for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == total[source] and r["target"] == pytest.approx(target[source])
        assert abs(taken[source] - target[source]) <= max(sizes.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op6_source_mixing")))


def test_flight_keeps_totals():
    draw = np.random.default_rng(1)
    p, size = draw.random(500), draw.integers(1, 900, 500)
    q = mixing.flight(p, size, 7)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_lm_scores(spark, docs):
    tokens = {i: [*WORD.findall((r["text"] or "").translate(LOW)), "\n"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count = Counter(w for i in docs if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    rows = run(spark, "op7_lm_scoring")
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(float(np.log10([(count[w] + 1) / (n + v + 1) for w in own]).sum()))
        assert r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_gains_on_held_out_texts(spark):
    """At least a seventh of a decade a token better than the unigram base on texts that were not learned from."""
    import pyspark.sql.functions as F

    scored = language_model.lm_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base, n = scored.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (score - base) / n >= 0.15


def test_lm_probabilities_sum_to_one(spark, monkeypatch):
    """Over all numbered words and, together, all others, in every context of a text."""
    kept, fit = {}, language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a, **k: kept.setdefault("model", fit(*a, **k)))
    texts = [f"a b {w} a c b {w}" for w in ("a", "b", "c", "d", "rare1", "d") for _ in range(9)] + ["once only"]
    language_model.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), head=5).collect()
    model = kept["model"]
    k = len(model.within)
    assert k == 6
    for before in ([], [1], [1, 2], [3, 5, 1], [4, 4, 4, 4]):
        ids = np.array([[*before, w] for w in range(k)]).ravel()
        place = np.tile(np.arange(len(before) + 1), k)
        last = language_model.word_scores(model, ids, place)[len(before) :: len(before) + 1]
        assert (10.0**last).sum() == pytest.approx(1, abs=1e-5)


def test_lm_odd_corpora(spark):
    """One training text, none at all, and words that only scored texts have."""
    import pyspark.sql.functions as F

    one = language_model.lm_score(spark.createDataFrame([(1, "a b"), (2, "a z")], "doc_id long, text string"), F.col("doc_id") == 2)
    got = {r["doc_id"]: r for r in one.collect()}
    assert (got[1]["n_known"], got[2]["n_known"], got[1]["train_tokens"]) == (3, 2, 3)
    assert got[1]["base_score"] == pytest.approx(3 * np.log10(2 / 7)) and got[2]["base_score"] == pytest.approx(2 * np.log10(2 / 7) + np.log10(1 / 7))
    none = language_model.lm_score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert all((r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(0) for r in none)


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x = {r["vec_id"]: embeddings.unit(np.array(r["embedding"], np.float64)) for r in rows}
    ids = sorted(x)
    near = np.stack([x[i] for i in ids]) @ np.stack([x[i] for i in ids]).T
    np.fill_diagonal(near, 0)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near >= 0.95), strict=True)]
    n, least = Counter(a for a, _ in links), reach(ids, links)
    for r in run(spark, "op8_embedding_near_dedup"):
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], least[r["vec_id"]], least[r["vec_id"]] == r["vec_id"])


@pytest.mark.parametrize("spread", [0.02, 0.08, 0.6])
def test_embeddings_over_several_levels_of_cells(spark, spread):
    draw = np.random.default_rng(11)
    heart = draw.normal(size=(12, 8))
    rows = (heart[draw.integers(0, 12, 900) ** 2 % 12] + spread * draw.normal(size=(900, 8))).astype(np.float32)
    rows[700:] = heart[0] + spread * draw.normal(size=(200, 8))  # a hot cell
    x = embeddings.unit(rows)
    near = x @ x.T
    np.fill_diagonal(near, 0)
    links = list(zip(*map(np.ndarray.tolist, np.nonzero(near >= 0.95)), strict=True))
    n, least = Counter(a for a, _ in links), reach(range(900), links)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(frame, block=16, most_pivots=3, fan=4).collect()}
    assert got == {i: (n[i], least[i]) for i in range(900)}


def test_scattered_embeddings_are_not_shuffled_to_meet(spark, monkeypatch):
    """All blocks may hold links between them: several rounds find every one, and shuffles stay a few times the vectors."""
    monkeypatch.setattr(embeddings, "ROUND_BYTES", 4 * 64 * 256, raising=False)
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(2000, 64)).astype(np.float32)
    rows[1400:] = rows[draw.integers(0, 300, 600)] + np.float32(0.15) * draw.normal(size=(600, 64)).astype(np.float32)
    x = embeddings.unit(rows)
    near = x @ x.T
    np.fill_diagonal(near, 0)
    links = list(zip(*map(np.ndarray.tolist, np.nonzero(near >= 0.95)), strict=True))
    n, least = Counter(a for a, _ in links), reach(range(2000), links)
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    shuffled = lambda: sum(executors().apply(k).totalShuffleWrite() for k in range(executors().size()))
    frame, before = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>"), shuffled()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(frame, block=64).collect()}
    assert len(links) > 1000 and got == {i: (n[i], least[i]) for i in range(2000)}
    assert shuffled() - before < 6 * rows.nbytes


def test_cover_tree_pairs_are_all_pairs():
    draw = np.random.default_rng(5)
    x = embeddings.unit(draw.normal(size=(400, 6)).astype(np.float32))
    tree = embeddings.Tree(x)
    got = {(int(a), int(b)) for i, j in embeddings.linked_pairs(tree, tree) for a, b in zip(i, j, strict=True)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.95)), strict=True))


def test_pairs_of_a_crowd_of_near_copies():
    """All pairs of two blocks may link, or some by chance; neither takes the memory of their vectors side by side."""
    draw = np.random.default_rng(6)
    heart = draw.normal(size=64)
    for spread in (0.05, 0.22):
        x, y = (embeddings.unit((heart + spread * draw.normal(size=(1500, 64))).astype(np.float32)) for _ in range(2))
        a, b = embeddings.Tree(x), embeddings.Tree(y)
        tracemalloc.start()
        got = [p * 1500 + q for p, q in embeddings.linked_pairs(a, b)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(np.sort(np.concatenate(got)), np.flatnonzero(x @ y.T >= 0.95)) and peak < 300e6


def test_odd_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(frame).collect()}
    assert got[1] == got[2] == got[9] == (2, 1)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 10)) and got[None] == (0, None)
    assert embeddings.embedding_near_dedup(frame.where("false")).count() == 0


def test_double_vectors_keep_their_precision(spark):
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0]), (2, at(0.95 + 1e-9)), (3, [1.0, -0.0]), (10, [1e-60, 0.0, 0.0]), (11, [1e-60, 0.0, 0.0]), (12, [0.0, 1e200, 1e199]), (13, [0.0, 2e200, 2e199]), (20, [0.0, 0.0, 1.0, 0.0]), (21, [0.0, *at(0.95 - 1e-9)[::-1], 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 10: (1, 10), 11: (1, 10), 12: (1, 12), 13: (1, 12), 20: (0, 20), 21: (0, 21)}


def test_mixing_spreads_equal_rows(spark):
    """Rows that are all alike are dealt over many blocks, and the target is met by each source."""
    import pyspark.sql.functions as F

    frame = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    rows = mixing.mix(frame, block=256)
    assert rows.count() == 30_000
    for r in rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("taken").alias("m")).collect():
        assert abs(r["t"] - r["target"]) <= 3 and r["m"] <= 6


def prints(text, words=3):
    parts = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fp = {i: prints(r["text"]) for i, r in docs.items()}
    ids = sorted(fp)
    least = reach(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = run(spark, "op10_simhash_near_dedup")
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fp[i]:016x}", least[i]) for i in ids}


def shingle_sets(texts, words=5):
    parts = {i: WORD.findall((t or "").translate(LOW)) for i, t in texts.items()}
    return {i: {tuple(p[k : k + words]) for k in range(max(1, len(p) - words + 1))} if p else set() for i, p in parts.items()}


def test_near_duplicate_groups(spark, docs):
    sets = shingle_sets({i: r["text"] for i, r in docs.items()})
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    alike = lambda a, b, s: len(a & b) >= s * len(a | b) if a or b else True
    ids = sorted(sets)
    sure = [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b], 0.9)]
    assert all(groups.get(a, a) == groups.get(b, b) for a, b in sure)
    least = reach(ids, [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b], 0.8)])
    assert all(least[i] == least[c] for i, c in groups.items())


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_near_copies_among_relatives(spark, similarity):
    """Pairs just above a similarity, each beside relatives at about 0.6 that have smaller ids: nine in ten are found at least."""
    draw, texts, pairs = np.random.default_rng(int(100 * similarity)), {}, []
    for _ in range(150):
        base = [f"w{k}" for k in draw.integers(1 << 40, size=300)]
        for _ in range(3):
            texts[len(texts)] = [*base[:225], *(f"w{k}" for k in draw.integers(1 << 40, size=75))]
        tail = int(300 * (1 - similarity) / (1 + similarity)) - 1  # shingles that only one side has
        texts[len(texts)] = base
        texts[len(texts)] = [*base[: 300 - tail], *(f"w{k}" for k in draw.integers(1 << 40, size=tail))]
        pairs.append((len(texts) - 2, len(texts) - 1))
    texts = {i: " ".join(t) for i, t in texts.items()}
    sets = shingle_sets(texts)
    assert all(similarity <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < similarity + 0.02 for a, b in pairs)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(frame, shape=simhash.band_shape(10**6)).collect()}
    assert np.mean([groups.get(a, a) == groups.get(b, b) for a, b in pairs]) >= 0.9
    kin = {a: b for b, a in pairs} | dict(pairs)
    assert all(i == c or kin.get(i) == c for i, c in groups.items())


def test_a_large_candidate_group_is_compared_in_blocks(spark, monkeypatch):
    """Near copies of one text in several blocks, and pairs in it that are like one another only."""
    monkeypatch.setattr(simhash, "TASK_WORDS", 3000)
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for k in range(60):
        near = list(base)
        near[int(draw.integers(200))] = f"x{k}"
        texts[k] = " ".join(near)
    for k in range(6):  # two by two, at about 0.6 to all others
        far = base[:150] + [f"y{k}z{j}" for j in range(50)]
        texts[100 + k], texts[200 + k] = " ".join(far), " ".join([*far[:-1], "end"])
    sets = shingle_sets(texts)
    want = reach(texts, [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shape=(8, 8)).collect()}
    assert {i: got.get(i, i) for i in texts} == want and len(set(want.values())) == 7


def test_string_ids_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [("b", text), ("a", text.upper()), ("c", "other words"), ("c", None), (None, text), ("d", "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_components(spark):
    draw = np.random.default_rng(2)
    links = [*draw.integers(0, 400, (300, 2)).tolist(), *[[k, k + 1] for k in range(1000, 1060)], [7, 7]]
    want = reach({n for pair in links if pair[0] != pair[1] for n in pair}, links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_url_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = run(spark, "op3_url_filter")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        url = pages[r["page_id"]] or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, r["verdict"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        assert r["verdict"] in ("allow", "block")


def test_url_trees_learn(spark):
    import pyspark.sql.functions as F

    frame = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("http://a.net/es/"), F.repeat(F.lit("9"), 40), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit("http://b.com/x"), (F.col("id") % 50).cast("string"))).when(F.col("id") % 4 == 2, F.concat(F.lit("http://c.org/"), F.repeat(F.lit("9"), 45), F.col("id").cast("string"))).otherwise(F.concat(F.lit("http://d.org/y"), (F.col("id") % 50).cast("string"))).alias("url"))
    got = urls.url_filter(frame).groupBy((F.col("page_id") % 4).alias("k")).agg(F.avg((F.col("verdict") == "block").cast("int")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}


def test_quality_classifier_held_out(spark):
    """Fitted on half of the ratings, it must tell good from other documents in the other half."""
    import pyspark.sql.functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality IS NOT NULL OR toxic = 1")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    scored = quality_classifier.quality_scores(docs.select("doc_id", "text"), labels.where(half == 0))
    truth = labels.where(half == 1).select("doc_id", quality_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rows = scored.join(truth, "doc_id").collect()
    right = np.mean([r["kept"] == (r["grade"] == 2) for r in rows])
    most = max(np.mean([r["grade"] == 2 for r in rows]), np.mean([r["grade"] != 2 for r in rows]))
    assert right >= max(0.85, most)


def test_licence_order(spark):
    text = "Permission note.\nReleased under the MIT License. All rights reserved.\nLicensed under CC BY 4.0"
    frame = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "licensed under the\tMIT   license!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["n_licenses"]) for r in licenses.license_scan(frame).collect()}
    assert got[1] == ("MitName AllRights CcBy4Name", 3) and got[4] == ("MitName", 1)
    assert got[2] == got[3] == ("", 0)
    assert line_dedup.MIN_CHARS == 10


def test_wrapped_licence_texts(spark):
    mit = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software"""
    bsd = """Copyright (c) 2015, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    lgpl = "This library is free software; you can"  # cut off: no licence
    texts = [mit, apache, bsd, gpl, mpl, "// SPDX-License-Identifier: MIT\nint x;", "a\nReleased under the MIT License\nb", lgpl]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(8)] == ["MIT", "Apache-2.0", "BSD-2-Clause", "GPL-3.0-or-later", "MPL-2.0", "MIT", "MIT", ""]


def test_near_copies_are_judged_by_distinct_shingles(spark):
    """Padding that outweighs all else makes neither copies of strangers nor strangers of copies."""
    texts = [" ".join(f"{p}{k}" for k in range(300)) for p in "abc"]
    padded = [f"{t} {'- ' * 330}" for t in texts]
    frame = spark.createDataFrame(list(enumerate([padded[0], padded[1], texts[2], padded[2], " ".join(["-"] * 330)])), "doc_id long, text string")
    got = simhash.near_duplicate_groups(frame).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {2: 2, 3: 2}


def test_near_copies_meet_past_a_hub(spark):
    """With one short band, all meet; the smallest documents at each place are no copies of the later pairs."""
    draw = np.random.default_rng(5)
    texts = [[f"w{k}" for k in draw.integers(1 << 40, size=120).tolist()] for _ in range(46)]
    texts += [[*t[:-1], "changed"] for t in texts[40:]]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.near_duplicate_groups(frame, shape=(4, 1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k // 46 * 6 for k in range(40, 52)}
