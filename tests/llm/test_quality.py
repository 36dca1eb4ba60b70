import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import AWKWARD, documents

from kindred.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b ", "é ", "\n", "a b c ", "#", "\t", "x y ", "\x1f", "<|"]) for _ in range(rng.randrange(40)))
        assert quality.text_stats(text)[:5] == brute(text)
    assert quality.text_stats(None) == (0,) * 10


def test_many_distinct_words_use_the_other_numbering():
    ids = np.array([0, 1, 2, 5, 0, 1, 2, 7])
    assert quality.repeated_words(ids, 7) == quality.repeated_words(ids, 3_000_000) == 6


def test_em_finds_defects_that_come_alone():
    rng = np.random.default_rng(0)
    good = np.where(rng.random((4000, 4)) < 0.01, -1, 1)
    rows, truth = [good], [np.ones(4000, bool)]
    for kind in range(3):  # the fourth voter's defect never happens
        bad = np.where(rng.random((250, 4)) < 0.01, -1, 1)
        bad[:, kind] = -1
        rows.append(bad)
        truth.append(np.zeros(250, bool))
    votes, truth = np.vstack(rows), np.concatenate(truth)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.Votes(patterns, counts.astype(float), kinds=True)
    found = model.posterior(votes) >= 0.5
    assert (found == truth).mean() > 0.97


@pytest.mark.parametrize("total", [10_000, 1_000_000])
@pytest.mark.parametrize("share", [0.01, 0.05, 1 / 3])
def test_one_unreliable_rule_is_outvoted(total, share):
    good = [1] * 8
    lone, other, both, two, more, abstains = (list(good) for _ in range(6))
    for votes, places in ((lone, [2]), (other, [0]), (both, [0, 2]), (two, [0, 5]), (more, [3, 4])):
        for i in places:
            votes[i] = -1
    abstains[7] = 0
    patterns = np.array([good, lone, two, more, abstains, both, other])
    counts = np.array([total * (1 - share) - 22, total * share - 4, 5, 5, 6, 4, 2])
    model = quality.Votes(patterns, counts, kinds=True)
    found = model.posterior(patterns)
    assert found[0] > 0.9 and found[1] >= 0.5
    assert model.chance[0, 2, 0] > 0.5 * share


def test_rows_are_judged(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, bad = [], set()
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        if i % 10 == 0:
            text = [w + "###" for w in text]
            bad.add(i)
        if i % 10 == 5:
            text = [w.upper() + "!!" for w in text]
            bad.add(i)
        rows.append((i, " ".join(text)))
    rows += [(1000, "too short"), (1001, " ".join(["again and again"] * 60))]
    out = {r.doc_id: r for r in quality.judge_quality(documents(spark, rows)).collect()}
    for i, text in rows:
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols, out[i].n_dup_lines, out[i].n_repeat_words) == brute(text)
    assert out[1000].base_failed and out[1001].base_failed and not out[1000].kept and not out[1001].kept
    assert not any(r.kept for i, r in out.items() if i in bad)
    assert all(r.kept for i, r in out.items() if i < 1000 and i not in bad)


def test_awkward_rows_and_empty_table(spark):
    out = quality.judge_quality(documents(spark, AWKWARD)).collect()
    assert len(out) == len(AWKWARD)
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality.judge_quality(documents(spark, AWKWARD).limit(0)).count() == 0
