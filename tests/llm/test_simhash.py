import random

import numpy as np
import xxhash
from tests.llm.helpers import AWKWARD, documents

from kindred.llm import simhash


def plain_print(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Smallest index reachable, by brute force."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["Ab", "é", "Xy z", "q"]) + str(rng.randrange(9)) for _ in range(n))
        assert simhash.fingerprint_of(text, 4) == plain_print(text)
    assert simhash.fingerprint_of(None, 4) == 0


def test_forest_finds_all_links_in_any_shape():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 40, 2)).astype(np.uint64)
    values = np.unique(np.concatenate([centres, (centres[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel()]))
    everyone = np.ones(len(values), bool)
    a, b = simhash.spanning(values, np.zeros(len(values), np.int64), everyone, everyone, 4)
    got = np.arange(len(values))
    got[a] = b
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = np.arange(len(values))
    while True:  # spread the smallest label
        new = np.where(near, want[None, :], len(values)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (got == want).all() and len(a) < len(values)


def test_block_plans_cover_the_radius():
    for count in (10, 10**6, 10**9, 10**12):
        blocks, masks = simhash.block_plan(count, 4)
        rng = random.Random(count)
        for _ in range(200):
            flipped = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not flipped & m for m in masks), blocks


def test_groups_against_brute_force_with_tiny_shards(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(120):
        words = [base[(i % 12) * 30 + k] for k in range(30)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(30)] = rng.choice(base)
        rows.append((i, " ".join(words)))
    prints = [plain_print(t) for _, t in rows]
    want = components(prints, 4)
    for shard_rows in (4096, 8):  # the second cuts the busy buckets into slices
        got = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, rows), shard_rows=shard_rows).collect()}
        assert [got[i].component_id for i in range(120)] == want
        assert [got[i].fp % 2**64 for i in range(120)] == prints


def test_awkward_rows_and_empty_table(spark):
    rows = simhash.simhash_groups(documents(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    empties = {(r.doc_id, r.component_id) for r in rows if r.fp == 0}
    assert empties == {(None, 1), (1, 1), (2, 1), (3, 1)}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.simhash_groups(documents(spark, AWKWARD).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark, [*AWKWARD, (4, AWKWARD[5][1])])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7] and ids.count(None) == 1
