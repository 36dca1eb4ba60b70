import random

import numpy as np
from tests.llm.helpers import AWKWARD, documents

from kindred.llm import hyperminhash


def plain_set(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == c) if sets[i] else rows[i][0] for i, c in enumerate(label)], sets


def families(seed, sizes):
    """Texts of some words each, with copies of more and more edits."""
    rng = random.Random(seed)
    rows = []
    for size, copies in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"v{rng.randrange(10**6)}"] * rng.randrange(2)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_registers_are_the_plain_ones():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 20_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        want = [0] * 256
        for h in sorted(hashes.tolist(), reverse=True):
            bits = f"{h & (2**56 - 1):056b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            want[h >> 56] = ((zeros + 1) << 10) + int((bits[zeros + 1 :] + "0" * 56)[:10], 2)
        assert hyperminhash.registers_of(hashes).tolist() == want


def test_estimate_and_bands_at_known_similarity():
    rng = np.random.default_rng(4)
    missed = total = 0
    for size in (5, 20, 200, 5000):
        errors = []
        for _ in range(120):
            union = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            cut = max(1, round(0.1 * len(union)))  # a tenth on each side is the other's alone
            union = rng.permutation(union)
            a, b = np.sort(union[cut:]), np.sort(np.concatenate([union[: len(union) - 2 * cut], union[:cut], union[len(union) - cut :]]))
            b = np.unique(b)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ra, rb = hyperminhash.registers_of(a)[None], hyperminhash.registers_of(b)[None]
            found, filled = hyperminhash.estimated_similarity(ra, rb, np.array([len(a)]), np.array([len(b)]))
            errors.append((found[0] - true) / np.sqrt(0.16 / filled[0]))
            if true >= 0.8:
                total += 1
                missed += not (hyperminhash.band_keys(ra) == hyperminhash.band_keys(rb)).any()
        assert abs(np.mean(errors)) < 0.5 and np.max(np.abs(errors)) < 5
    assert total > 100 and missed == 0


def test_chance_agreement_against_simulation():
    rng = np.random.default_rng(5)
    for n, m in ((100, 100), (2000, 300)):
        agree = [
            (lambda a, b: ((a == b) & (a > 0)).sum())(*(hyperminhash.registers_of(np.sort(rng.integers(0, 2**64, k, dtype=np.uint64))) for k in (n, m)))
            for _ in range(4000)
        ]
        want = hyperminhash.chance_agreement(np.array([n]), np.array([m]))[0] * 256
        assert abs(np.mean(agree) - want) < 5 * np.sqrt(want / 4000)


def test_tiles_connect_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    sets = []
    for _ in range(160):
        kept = base[rng.random(150) > rng.choice([0.02, 0.08, 0.2])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, rng.integers(20), dtype=np.uint64)])))
    everyone = np.arange(len(sets))
    similar = np.array([[len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    common = hyperminhash._common(sets, everyone[:70], everyone[70:])
    assert (common == [[len(np.intersect1d(a, b)) for b in sets[70:]] for a in sets[:70]]).all()
    want = everyone.copy()
    while True:
        new = np.where(similar, want[None, :], len(sets)).min(axis=1)
        if (new == want).all():
            break
        want = new
    links = hyperminhash.spanning_links(sets, everyone, everyone, everyone, 80)
    got = everyone.copy()
    for a, b in links:
        assert similar[a, b]
        got[got == got[a]] = got[b]
    assert len(links) < len(sets) and len(set(got.tolist())) == len(set(want.tolist())) == len(set(zip(got.tolist(), want.tolist())))
    assert 1 < len(set(want.tolist())) < 100


def test_groups_against_brute_force(spark):
    rows = families(6, [(3, 4), (4, 4), (5, 6), (7, 8), (9, 8), (24, 20), (40, 30), (60, 60), (200, 20), (1000, 6), *[(30, 1)] * 40])
    # a chain: every text shares enough with the next one only
    words = [f"c{i}" for i in range(400)]
    rows += [(2 + 3 * i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)]
    want, sets = components(rows)
    for tile_rows in (1000, 7):  # the second cuts bands into slices
        got = {r.doc_id: r for r in hyperminhash.near_duplicates(documents(spark, rows), tile_rows=tile_rows).collect()}
        assert [got[i].component_id for i, _ in rows] == want
    assert [got[i].n_shingles for i, _ in rows] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert 60 < len(set(want)) < len(rows) - 60


def test_awkward_rows_and_empty_table(spark):
    docs = documents(spark, AWKWARD)
    rows = hyperminhash.near_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD)
    empties = {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == 0}
    assert empties == {(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id == 5] == [(4, False)] * 2
    assert [r.n_shingles for r in rows if r.doc_id in (6, 7)] == [59_997, 1]
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0
    nameless = documents(spark, [(None, "one two three four five six"), (None, "One two three four five six"), (8, "one two three")])
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in hyperminhash.near_duplicates(nameless).collect()) == [(0, 0, True)] * 2 + [(8, 8, True)]
