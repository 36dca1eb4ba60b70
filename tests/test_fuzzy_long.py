import random

import numpy as np
import pytest

from kindred.functions import distance
from kindred.functions.distance import IndelTexts, indel_ratios
from kindred.operators import fuzzy
from kindred.operators.fuzzy import SCORERS, assign_representatives


@pytest.mark.parametrize("few, lane, step", [(0, 8, 7), (0, 1 << 14, 64), (48, 1 << 14, 64)])
def test_one_text_against_many_long_ones(monkeypatch, few, lane, step):
    monkeypatch.setattr(distance, "_FEW_WORDS", few)
    monkeypatch.setattr(distance, "_BAND_WORDS", lane)
    monkeypatch.setattr(distance, "_STEP", step)
    rng = random.Random(few + step)
    for alphabet in ("ab", "aé漢😀 bcdefgh"):
        for size in (0, 1, 62, 63, 64, 126, 300, 700):
            one = "".join(rng.choices(alphabet, k=size))
            texts = ["", "".join(rng.choices(alphabet, k=size))]
            for _ in range(20):
                other = list(one)
                for _ in range(rng.randrange(1 + size // 3)):
                    at = rng.randrange(len(other) + 1)
                    other[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(alphabet)])
                texts.append("".join(other))
            found, index = IndelTexts(texts), np.arange(1, len(texts))
            for threshold in (0, 60, 85, 94, 100):
                want = index[indel_ratios(texts[1:], [one] * len(index)) >= threshold]
                assert found.reaches(one, index, threshold).tolist() == want.tolist()


def test_common_signatures_are_not_joined(spark, monkeypatch):
    """Texts that share most grams would meet at each of them; they meet by length, once."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh", k=rng.randrange(20, 150))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts[:20]]
    nodes = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "block string, node long, text string")
    monkeypatch.setattr(fuzzy, "join_pairs", None)
    got = sorted(map(tuple, fuzzy.similar_pairs(nodes, 85).collect()))
    ids = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    score = indel_ratios([texts[i] for i, _ in ids], [texts[j] for _, j in ids])
    assert got == [p for p, s in zip(ids, score) if s >= 85] and got


def test_sweeps_that_remove_nothing_end(spark, monkeypatch):
    """Small blocks that one sweep decides say nothing about the long texts of a large one."""
    rng = random.Random(8)
    rows = [(f"b{i // 6}", i, f"b{i // 6} {i}") for i in range(360)]
    texts = ["".join(rng.choices("abcdefghij", k=400)) for _ in range(100)]
    texts += [t[:-3] for t in texts[:5]]
    rows += [("x", 1000 + i, t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "block string, node long, text string")
    sweeps, plain = [], fuzzy._sweep
    monkeypatch.setattr(fuzzy, "_sweep", lambda *a: sweeps.append(a) or plain(*a))
    got = [
        tuple(r) for r in assign_representatives(nodes, SCORERS["ratio"], 90, leaders=16).collect() if r["node"] >= 1000
    ]
    assert sorted(got) == [(1100 + i, 1000 + i) for i in range(5)]
    assert len(sweeps) == 1
