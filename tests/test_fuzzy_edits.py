import random

import numpy as np
import pytest

from kindred.functions import distance
from kindred.functions.distance import EditTexts, levenshtein_ratios
from kindred.operators import fuzzy
from kindred.operators.fuzzy import SCORERS, assign_representatives, dedup_fuzzy, pairs_of_like_length


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def some_texts(n, seed, longest=200, letters="abcé😀 "):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(1 + n // 6)]
    out = []
    for _ in range(n):
        text = list(rng.choice(stems))
        for _ in range(rng.randrange(1 + len(text) // 3)):
            text[rng.randrange(len(text))] = rng.choice(letters)
        out.append("".join(text[: len(text) - rng.randrange(1 + len(text) // 3)]))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé😀 ", "abcdefghijklmnopqrstuvwxyz"])
def test_edits_of_many_texts_at_once(letters, monkeypatch):
    texts = some_texts(40, 1, letters=letters) + ["", "", "a", "a" * 62, "a" * 63, "a" * 64, "b" * 126, "a" * 300]
    wanted = np.array([[edits(x, y) for y in texts] for x in texts])
    longest = np.array([[max(len(x), len(y)) for y in texts] for x in texts])
    known, index = EditTexts(texts), np.arange(len(texts))
    assert (known.distances(texts, index) == wanted).all()
    some = np.array([9, 2, 44, 7])
    for threshold in (0, 35, 80, 100):
        reached = longest - wanted >= threshold * longest / 100 - 1e-9
        assert (known.reaches(texts[3:9], some, threshold) == reached[3:9][:, some]).all()
    monkeypatch.setattr(distance, "_LANE_WORDS", 8)
    monkeypatch.setattr(distance, "_PLACES_WORDS", 1)
    assert (EditTexts(texts).distances(texts, index) == wanted).all()


@pytest.mark.parametrize("threshold, leaders, rows_per_task", [(35, 2, 3), (60, 1, 50), (80, 6, 20), (80, 2048, 20_000), (0, 2, 9)])
def test_representatives_by_edits(spark, threshold, leaders, rows_per_task):
    """Whether decided by sweeps or, where these remove too little, by pairs: as in a loop over the rows."""
    texts = ["x" + t for t in some_texts(90, threshold, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = dedup_fuzzy(df, ["text"], threshold, "levenshtein_ratio", id_col="id", leaders=leaders, rows_per_task=rows_per_task)
    reps, wanted = [], []
    for i, text in enumerate(texts):
        rep = next((r for r, t in reps if levenshtein_ratios([text], [t])[0] >= threshold - 1e-9), None)
        if rep is None:
            reps.append((i, text))
        else:
            wanted.append((rep, i))
    assert sorted((r["kept_index"], r["removed_index"]) for r in found.members.collect()) == sorted(wanted)


@pytest.mark.parametrize("threshold", [35, 80])
def test_pairs_by_edits(spark, threshold):
    texts = sorted({*some_texts(70, 4), "", "a", "b"})
    nodes = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "block string, node long, text string").repartition(3)
    want = sorted((i, j) for j in range(len(texts)) for i in range(j)
                  if levenshtein_ratios([texts[i]], [texts[j]])[0] >= threshold - 1e-9)
    for tile_rows in (500, 5):
        assert sorted(map(tuple, pairs_of_like_length(nodes, threshold, tile_rows, SCORERS["levenshtein_ratio"]).collect())) == want


def test_rows_meet_representatives_only(spark, monkeypatch):
    """A family of near copies makes no pairs among its members."""
    monkeypatch.setattr(fuzzy, "scored_pairs", lambda *a: pytest.fail("all pairs of a block were made"))
    nodes = spark.createDataFrame([("x", i, "x" * 40 + str(i)) for i in range(300)], "block string, node long, text string")
    found = assign_representatives(nodes, SCORERS["levenshtein_ratio"], 80, leaders=10, rows_per_task=50)
    assert {r["rep"] for r in found.collect()} == {0} and found.count() == 299

    met = []
    plain = EditTexts.reaches
    monkeypatch.setattr(EditTexts, "reaches", lambda self, others, index, t: met.append(len(others) * len(index)) or plain(self, others, index, t))
    texts = [f"{stem * 150}{i:03}" for i in range(150) for stem in "abcd"]
    rep = fuzzy._decide_by_edits(texts, np.arange(600), 80)
    assert set(rep.tolist()) == {0, 1, 2, 3}
    assert sum(met) < 10 * 600
