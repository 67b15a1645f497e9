"""Every registered query of the library itself: equal to its SQL, or at least a stable table."""

import inspect

import numpy as np
import pytest

from granary.plans import queries as plans
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(plans.queries()[name](spark, SF_DIR), plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_is_stable(spark, name):
    run = lambda: sorted(map(repr, plans.queries()[name](spark, SF_DIR).collect()))
    assert run() == run()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_split_search_runs_every_trial(spark, monkeypatch):
    asked = inspect.signature(plans.split.search)
    monkeypatch.setattr(plans.split, "search", lambda *a, **k: asked.bind(*a, **k))
    bound = plans.queries()["split_search"](spark, SF_DIR)
    bound.apply_defaults()
    assert (bound.arguments["trials"], bound.arguments["seed"]) == (2000, 42)


def test_ratio_score_is_the_score_of_the_sums(spark):
    rows = [("train", 1, "a"), ("train", 1, "a"), ("train", 2, "b"), ("val", 3, "a"), ("val", 4, None), ("train", 5, "c")]
    got = plans.split.ratio_score(spark.createDataFrame(rows, "split string, image long, cls string"), "split", "image", "cls").first()["score"]
    images, counts, presence = np.array([3.0, 2, 0]), np.array([[2.0, 1, 1], [1, 0, 0], [0, 0, 0]]), np.array([[1.0, 1, 1], [1, 0, 0], [0, 0, 0]])
    assert got == pytest.approx(plans.split.score(images, counts, presence), abs=1e-6)
    assert plans.split.ratio_score(spark.createDataFrame([], "split string, image long, cls string"), "split", "image", "cls").first()["score"] == 4.0


def test_greedy_split_fills_targets():
    images = np.array([10.0] * 20)
    large = [images, np.array([[5.0, 10.0]] * 20), np.array([[5.0, 10.0]] * 20)]
    to = plans.split._place(large, [np.zeros(3), np.zeros((3, 2)), np.zeros((3, 2))], [x.sum(0) for x in large], 1, plans.split.RATIOS)
    assert np.bincount(to, minlength=3).tolist() == [14, 3, 3]


def test_nail_head_is_the_wide_end(spark):
    shaft = [("n", x, y) for x in range(10, 90) for y in range(20, 25)]
    head = [("n", x, y) for x in range(78, 90) for y in range(10, 35)]
    lone = [("dot", 3, 3)]
    same = [("pair", 5, 5), ("pair", 6, 5)]
    frame = spark.createDataFrame(sorted(set(shaft + head)) + lone + same, "i string, x int, y int")
    got = {r["i"]: r for r in plans.skeleton.t_profile(frame, "i").collect()}
    nail = got["n"]
    assert nail["status"] == "ok_t_profile_skeleton" and abs(nail["angle_deg"]) < 1
    assert (nail["tip_x"], nail["tip_y"], nail["head_y"]) == (10, 22, 22) and nail["head_x"] in (82, 83, 84)
    assert nail["cap_x1"] == nail["cap_x2"] == nail["head_x"] and nail["cap_y2"] - nail["cap_y1"] in (18, 19, 20)
    assert nail["length_px"] == nail["head_x"] - nail["tip_x"]
    assert (got["dot"]["status"], got["dot"]["length_px"], got["dot"]["tip_x"]) == ("needs_review_no_clear_t_profile", 0.0, None)
    assert (got["pair"]["angle_deg"], got["pair"]["length_px"]) == (None, 0.0)


def test_beam_statuses(spark):
    bar = [("bar", x, y) for x in range(100, 160) for y in range(50, 55)]
    cross = [("cross", x, y) for x in range(60) for y in range(28, 33)] + [("cross", x, y) for x in range(28, 33) for y in range(60)]
    ring = [("ring", x, y) for x in range(20) for y in range(20) if min(x, y) == 0 or max(x, y) == 19]
    few = [("few", x, 0) for x in range(49)]
    frame = spark.createDataFrame(sorted(set(bar + cross + ring + few)), "i string, x int, y int")
    got = {r["i"]: r for r in plans.skeleton.beam_geometry(frame, "i").collect()}
    assert got["bar"]["status"] == "ok" and 50 <= got["bar"]["length_px"] <= 60 and abs(got["bar"]["angle_deg"]) < 5
    assert 100 <= got["bar"]["first_x"] < got["bar"]["last_x"] < 160 and 50 <= got["bar"]["first_y"] < 55
    assert got["cross"]["status"] in ("branched_needs_review", "ok_pruned_main_path") and got["cross"]["n_branches"] > 0
    assert got["ring"]["n_ends"] == 0 and got["ring"]["length_px"] > 30
    assert (got["few"]["status"], got["few"]["length_px"], got["few"]["first_x"]) == ("skipped_small_mask", 0.0, None)


def test_geometry_rows_follow_the_class(spark):
    bar = [(x, y) for x in range(60) for y in range(5)]
    classes = {1: "I-Beam", 2: "NAIL", 3: "brick", 4: "pipe", 5: None}
    rows = [(i, c, x, y) for i, c in classes.items() for x, y in bar] + [(6, "pipe", 1, 1)]
    got = {r["i"]: r for r in plans.skeleton.geometry_rows(spark.createDataFrame(rows, "i int, cls string, x int, y int"), "cls", "i").collect()}
    assert {i: (r["cls"], r["status"]) for i, r in got.items()} == {
        1: ("I-Beam", "ok"),
        2: ("NAIL", "ok_t_profile_skeleton"),
        4: ("pipe", "ok_clean_axis"),
        5: (None, "ok_clean_axis"),
        6: ("pipe", "needs_review_no_clear_axis"),
    }
    line = got[4]
    assert (line["first_x"], line["first_y"], line["last_x"], line["last_y"], line["length_px"], line["angle_deg"]) == (0, 2, 59, 2, 59.0, 0.0)
    assert (got[6]["length_px"], got[6]["first_x"]) == (0.0, None)


def test_filled_balance_deals_its_join_by_size(spark):
    parts = plans.parts
    cores = spark.sparkContext.defaultParallelism
    assert [parts(spark, 0), parts(spark, 500_000 * cores + 1), parts(spark, 36_000_000)] == [cores, cores + 1, max(cores, 72)]
    plan = plans.queries()["audit_filled_balance"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
