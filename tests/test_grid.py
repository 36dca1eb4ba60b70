import random

import pyarrow as pa
import pytest

from conftest import rows_of
from kindred.config import LinkConfig
from kindred.functions.distance import jaro_winklers
from kindred.functions.levels import LevelRows, Texts
from kindred.linkage import grid
from kindred.linkage.candidates import candidate_levels, candidate_pairs, needed_agreement, with_levels
from kindred.linkage.model import LinkModel
from kindred.linkage.records import merge_copies, record_rows
from kindred.linkage.runs import score, score_levels
from kindred.linkage.train import blocked_patterns
from kindred.plans.ids import with_row_id

CONFIG = LinkConfig({"name": "name", "mail": "email", "phone": "phone", "city": "exact"}, blocking=("city", "phone"))
MODEL = LinkModel(
    0.05, CONFIG.comparisons,
    {"name": [0.1, 0.2, 0.2, 0.2, 0.3], "mail": [0.1, 0.2, 0.2, 0.2, 0.3], "phone": [0.1, 0.2, 0.3, 0.4], "city": [0.1, 0.9]},
    {"name": [0.5, 0.3, 0.1, 0.09, 0.01], "mail": [0.5, 0.3, 0.1, 0.09, 0.01], "phone": [0.9, 0.09, 0.009, 0.001], "city": [0.7, 0.3]},
)


def word(rng, longest=9):
    return "".join(rng.choice("abé") for _ in range(rng.randrange(longest)))


def records(spark, n, seed, config=CONFIG):
    rng = random.Random(seed)
    rows = [
        (i * 3 % 1009, rng.choice([None, word(rng), word(rng) + " " + word(rng), "ab" * 40 + word(rng)]),
         rng.choice([None, "no address", f"{word(rng, 4)}@{word(rng, 4)}.x", f"{word(rng)}@é.x"]),
         rng.choice([None, str(rng.randrange(900, 1000)), "12345"]), rng.choice([None, "A", "A", "B"]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id long, name string, mail string, phone string, city string")
    return merge_copies(record_rows(with_row_id(df, id_col="id"), config)).localCheckpoint()


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(grid, "GRID_PAIRS", 40)
    monkeypatch.setattr(grid, "GRID_ROWS", 16)
    monkeypatch.setattr(grid, "_FLUSH", 50)


def test_one_text_against_many():
    rng = random.Random(3)
    one, many = [word(rng, 90) for _ in range(25)], [word(rng, 90) for _ in range(60)] + ["", "a" * 64, "b" * 65]
    texts = Texts(many)
    for a in one:
        start = rng.randrange(20)
        assert (texts.jaro_winkler(a, start) == jaro_winklers(pa.array([a] * len(many[start:])), pa.array(many[start:]))).all()
    near = [a[: max(0, len(a) - rng.randrange(3))] + rng.choice(["", "b"]) for a in one]
    rows = LevelRows("phone", one, near)
    for i, a in enumerate(one):
        for got, b in zip(rows.row(i, 0).tolist(), near):
            assert got == {0: 3, 1: 2, 2: 1}.get(edits(a.encode(), b.encode()), 0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("two", [False, True])
def test_levels_and_scores_of_large_groups_are_those_of_the_join(spark, small_tiles, two):
    left, right = records(spark, 150, 1), records(spark, 90, 2) if two else None
    plain = with_levels(candidate_pairs(left, right, 2), CONFIG)
    tiled = candidate_levels(left, right, 2, CONFIG)
    assert "MapInArrow" in tiled._jdf.queryExecution().toString() or "InArrow" in tiled._jdf.queryExecution().toString()
    assert tiled.dtypes == plain.dtypes
    assert rows_of(tiled) == rows_of(plain)
    for threshold in (0.3, 0.9):
        needed = needed_agreement(CONFIG, MODEL, threshold)
        few = candidate_levels(left, right, 2, CONFIG, also_equal=needed, model=MODEL, threshold=threshold)
        wanted = score(candidate_pairs(left, right, 2), CONFIG, MODEL, threshold).drop("match_key")
        assert rows_of(score_levels(few, MODEL, threshold).drop("match_key")) == rows_of(wanted)


@pytest.mark.parametrize("two", [False, True])
def test_patterns_of_large_groups_are_those_of_the_pairs(spark, small_tiles, monkeypatch, two):
    left, right = records(spark, 300, 4), records(spark, 200, 5) if two else None
    tiled = rows_of(blocked_patterns(left, right, CONFIG))
    monkeypatch.setattr(grid, "GRID_PAIRS", 1 << 60)
    assert tiled == rows_of(blocked_patterns(left, right, CONFIG))
