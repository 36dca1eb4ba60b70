import random
import re
from collections import Counter

import numpy as np
from tests.llm.helpers import AWKWARD, documents

from kindred.llm import phrases


def brute(rows, least, top, percent=50):
    """Phrases by definition; rows of (lang, text)."""
    grams = [Counter(), Counter(), Counter(), Counter()]
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    grams[k]["und" if lang is None else lang, *words[i : i + k]] += 1
    out = []
    for k in (2, 3):
        for key, a in grams[k].items():
            if a < least:
                continue
            lang, words = key[0], key[1:]
            longer = [f for other, f in grams[3].items() if k == 2 and f >= least and other[0] == lang and words in (other[1:3], other[2:4])]
            if any(100 * f >= percent * a for f in longer):
                continue
            cuts = []
            for c in range(1, k):
                left, right = grams[c][lang, *words[:c]], grams[k - c][lang, *words[c:]]
                cuts.append((1_000_000 * a * a // (left * right), c, left, right))
            score, _, left, right = min(cuts)
            n = sum(f for w, f in grams[1].items() if w[0] == lang)
            out.append((lang, " ".join(words), a, left, right, n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def texts(seed, count):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "É", "x1", "\x00", "ß\xa0y", "co-op", "_"]
    weights = [9, 2, 6, 3, 3, 2, 1, 1, 1, 1, 1, 1, 1]
    out = []
    for _ in range(count):
        parts = []
        for word in rng.choices(vocabulary, weights, k=rng.randrange(40)):
            parts += [word, rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ? "])]
            if rng.random() < 0.15:
                parts += ["new york city", " "]
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(parts)))
    return out


def test_trie_finds_every_phrase_and_no_other():
    rng = np.random.default_rng(1)
    for largest, count, words in ((0, 1, 2), (5, 20, 2), (3000, 4000, 2), (3000, 2500, 3), (5_000_000, 3000, 3), (2**31 - 2, 500, 2)):
        rows = rng.integers(0, largest + 1, (count, words))
        rows[: count // 2, 0] = rng.integers(0, min(largest, 3) + 1)  # a word with very many successors
        rows = np.unique(rows, axis=0)
        trie = phrases.DoubleArray.build(rows, largest)
        inner = (trie.check >= 0).sum()
        assert inner < len(trie.check) and len(trie.check) < 20 * inner + 10 * 2048
        picked = rows[rng.permutation(len(rows))]
        noise = np.unique(rng.integers(0, largest + 1, (count, words)), axis=0)
        for sample in (picked, noise):
            codes = np.concatenate([np.append(r, -1) for r in sample]).astype(np.int32)
            at, number = trie.matches(codes, words)
            known = {tuple(r): i for i, r in enumerate(rows.tolist())}
            want = [(i * (words + 1), known[tuple(r)]) for i, r in enumerate(sample.tolist()) if tuple(r) in known]
            assert list(zip(at.tolist(), number.tolist())) == want
        assert trie.matches(np.zeros(0, np.int32), words)[0].size == 0


def test_against_brute_force_in_one_round_and_in_many(spark):
    rows = texts(2, 600)
    docs = spark.createDataFrame([(t, g, "x", "y") for g, t in rows], "text string, lang string, word string, pair string").repartition(5)
    want = brute(rows, 10, 25)
    assert len(want) > 60 and len({r[0] for r in want}) == 4
    for block_words, trie_phrases in ((1_000_000, 1_000_000), (300, 7)):
        got = phrases.collocations(docs, top=25, block_words=block_words, trie_phrases=trie_phrases)
        assert sorted(map(tuple, got.collect())) == want


def test_rows_that_are_empty_long_repeated_or_none(spark):
    docs = documents(spark, [*AWKWARD, *[(9, "one two three four")] * 12])
    got = phrases.collocations(docs).collect()
    assert {(r.phrase, r.a, r.l, r.r, r.score) for r in got} == {("one two three", 12, 12, 12, 10**6), ("two three four", 12, 12, 12, 10**6)}
    assert phrases.collocations(docs.limit(0)).count() == 0
    rare = spark.createDataFrame([("a b c", None)], "text string, lang string")
    assert phrases.collocations(rare).count() == 0
