"""Records alike in all but their ids meet as lists of ids in large groups."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.config import LinkConfig
from kindred.linkage.candidates import candidate_levels, candidate_pairs
from kindred.plans.pairs import alike, join_lists, join_pairs

SCHEMA = "id long, copies long, v0 string, k0 string, k1 string"


def _rows(n, seed, first=0):
    draw = random.Random(seed)
    ids = draw.sample(range(first, first + 10 * n), n)
    return [(i, 1, draw.choice(["a", "b", None]), draw.choice(["x", "x", "y", None]), draw.choice(["p", "q", None])) for i in ids]


def _met(a, b, same):
    """id_l, id_r, match_key of two rules, pair by pair."""
    out = []
    for x in a:
        for y in b:
            if same and x[0] >= y[0]:
                continue
            rules = [r for r, k in enumerate((3, 4)) if x[k] is not None and x[k] == y[k]]
            if rules:
                out.append((x[0], y[0], rules[0]))
    return sorted(out)


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("tile_rows", [7, 30, 1_000])
def test_lists_make_the_pairs_of_the_join(spark, same, tile_rows):
    a, b = _rows(90, 1), _rows(70, 2, 5_000)

    def side(rows, s):
        return spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], f"id_{s} long, v_{s} string, k string").dropna(subset=["k"])

    left, right = side(a, "l"), side(a if same else b, "r")
    args = (left, right, ["k"], "id_l", "id_r", same, tile_rows)
    lists, rows = join_lists(*args), join_pairs(*args)
    got = sorted(map(str, lists.select(rows.columns).collect()))
    assert got == sorted(map(str, rows.collect())) and len(got) > 1_000


@pytest.mark.parametrize("same", [True, False])
def test_large_groups_meet_as_lists(spark, same):
    a, b = _rows(120, 3), _rows(100, 4, 5_000)
    left = spark.createDataFrame(a, SCHEMA).localCheckpoint()
    right = None if same else spark.createDataFrame(b, SCHEMA).localCheckpoint()
    pairs = candidate_pairs(left, right, 2, tile_rows=20, ids_only=True)
    assert pairs.columns == ["id_l", "id_r", "match_key"]
    assert sorted(map(tuple, pairs.collect())) == _met(a, a if same else b, same)
    assert "collect_list" in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("same", [True, False])
def test_levels_of_equality_are_taken_per_list(spark, same):
    config = LinkConfig({"v": "exact"}, blocking=("x", "y"))
    a, b = _rows(400, 5), _rows(300, 6, 5_000)
    left = spark.createDataFrame(a, SCHEMA).localCheckpoint()
    right = None if same else spark.createDataFrame(b, SCHEMA).localCheckpoint()
    out = candidate_levels(left, right, 2, config, tile_rows=50)
    values = {r[0]: r[2] for r in [*a, *b]}
    got = [tuple(r) for r in out.select("id_l", "id_r", "match_key").collect()]
    assert sorted(got) == _met(a, a if same else b, same)
    for r in out.select("id_l", "id_r", "gamma_0").distinct().collect():
        x, y = values[r.id_l], values[r.id_r]
        assert r.gamma_0 == (-1 if x is None or y is None else int(x == y))
    assert "collect_list" in out._jdf.queryExecution().executedPlan().toString()


def test_records_that_differ_stay_with_the_row_join(spark):
    left = spark.createDataFrame([(i, 1, f"v{i}", "x", "p") for i in range(100)], SCHEMA).localCheckpoint()
    config = LinkConfig({"v": "exact"}, blocking=("x",))
    assert alike(left, "id") == 1.0 and alike(left.where(F.lit(False)), "id") == 0.0
    out = candidate_levels(left, None, 1, config, tile_rows=20)
    assert out.count() == 4_950
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
