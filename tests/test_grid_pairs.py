import random

import numpy as np

from kindred.functions import levels
from kindred.functions.levels import LevelRows
from kindred.linkage import grid


def test_single_pairs_have_the_levels_of_rows():
    rng = random.Random(12)
    for alphabet in ("ab", "abcdefé漢 @", "0123456789"):
        for width in (3, 16, 40, 90):
            left, right = (["".join(rng.choices(alphabet, k=rng.randrange(width))) for _ in range(n)] + [None] for n in (40, 30))
            right += left[:5]
            for kind in ("name", "email"):
                rows = LevelRows(kind, left, right)
                at_l, at_r = np.divmod(np.arange(len(left) * len(right)), len(right))
                want = np.concatenate([rows.row(i, 0) for i in range(len(left))])
                assert rows.of_pairs(at_l, at_r).tolist() == want.tolist()


def test_single_pairs_are_compared_together(monkeypatch):
    monkeypatch.setattr(levels, "name_levels", None, raising=False)
    rows = LevelRows("name", ["Customer#1", "Supplier#2"], ["Supplier#1", "Supplier#2"])
    assert rows.of_pairs(np.array([1, 1]), np.array([0, 1])).tolist() == [3, 4]


def test_second_table_lies_in_wide_tiles(spark, monkeypatch):
    """One record meets many at once, so the side met is cut into fewer slices."""
    monkeypatch.setattr(grid, "GRID_PAIRS", 40)
    monkeypatch.setattr(grid, "GRID_ROWS", 16)
    monkeypatch.setattr(grid, "GRID_WIDE", 64, raising=False)
    a = spark.createDataFrame([("A",)] * 100, "k0 string")
    b = spark.createDataFrame([("A",)] * 100, "k0 string")
    assert [r[1:] for r in grid.large_groups(a, b, ["k0"], ["_key0"]).collect()] == [(7, 2)]
    assert [r[1:] for r in grid.large_groups(a, None, ["k0"], ["_key0"]).collect()] == [(7, 7)]
