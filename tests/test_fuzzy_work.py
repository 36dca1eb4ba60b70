import random

import numpy as np

from kindred.functions.distance import ShortTexts, indel_ratios
from kindred.operators import fuzzy
from kindred.operators.fuzzy import dedup_fuzzy


def test_one_short_text_against_many():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(65))) for _ in range(200)] + ["", "a" * 64]
    laid_out = ShortTexts(texts)
    for one in ["", "ab" * 50, *texts[:40]]:
        index = np.array(sorted(rng.sample(range(len(texts)), 60)))
        assert laid_out.ratios(one, index).tolist() == indel_ratios([texts[i] for i in index], [one] * 60).tolist()


def test_long_texts_take_the_place_of_several_leaders(spark, monkeypatch):
    """Few long texts are decided and met in one task; who joins whom stays the same."""
    rng = random.Random(9)
    stems = ["x" + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 1500))) for _ in range(12)]
    rows = [(i, s[: len(s) - rng.randrange(1 + len(s) // 5)]) for i, s in enumerate(stems * 4)]
    df = spark.createDataFrame(rows, "id long, text string")
    seen = []
    plain = fuzzy._meet_leaders
    monkeypatch.setattr(fuzzy, "_meet_leaders", lambda *a: seen.append(a) or plain(*a))
    found = dedup_fuzzy(df, ["text"], 85, id_col="id", leaders=48, rows_per_task=40).members
    assert seen, "48 rows were decided in one task, however long they are"
    reps, wanted = [], []
    for i, text in rows:
        text = " ".join(sorted(text.lower().split()))
        rep = next((r for r, t in reps if indel_ratios([text], [t])[0] >= 85), None)
        if rep is None:
            reps.append((i, text))
        else:
            wanted.append((rep, i))
    assert sorted((r["kept_index"], r["removed_index"]) for r in found.collect()) == sorted(wanted)
