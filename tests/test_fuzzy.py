import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from checks.queries import dedup_fuzzy_conversations, dedup_fuzzy_documents
from conftest import rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kindred.errors import ColumnNotFoundError, InvalidConfigError
from kindred.functions.distance import indel_ratios, indel_reaches, lcs_lengths
from kindred.functions.signature import gram_size, signature
from kindred.operators.fuzzy import (
    SCORERS, assign_representatives, batch_scorer, column_scorer, dedup_fuzzy, first_representatives, pairs_of_like_length, similar_pairs,
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def token_sort_ratio(a, b):
    a, b = (" ".join(sorted(t.split())) for t in (a, b))
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def representatives(matches):
    """For each row the representative it belongs to, from the definition: a row is a representative
    iff no earlier representative matches it, and belongs to the earliest that does.

    ``matches[i, j]``: row i matches the earlier row j. Solved as a fixed point from an arbitrary
    start: row i is settled once all rows before it are."""
    n = len(matches)
    is_rep = np.ones(n, bool)
    earlier = np.tril(matches, -1)
    for _ in range(n):
        new = ~(earlier & is_rep).any(axis=1)
        if (new == is_rep).all():
            break
        is_rep = new
    owner = np.where(is_rep, np.arange(n), np.argmax(earlier & is_rep, axis=1))
    return owner


def by_definition(keys, threshold, block_size, score=token_sort_ratio):
    """The audit, from all scores."""
    lower = [k.lower() for k in keys]
    block = [k[:block_size] for k in lower]
    matches = np.array([[block[i] == block[j] and j < i and score(lower[i], lower[j]) >= threshold
                         for j in range(len(keys))] for i in range(len(keys))]).reshape(len(keys), -1)
    owner = representatives(matches)
    groups = {}
    for i, rep in enumerate(owner.tolist()):
        if i != rep:
            groups.setdefault(rep, []).append(str(i))
    order = sorted(groups, key=lambda rep: (block.index(block[rep]), rep))
    return [(n, "fuzzy", lower[rep], rep, ",".join(groups[rep]), len(groups[rep])) for n, rep in enumerate(order, 1)]


def some_names(n, seed):
    rng = random.Random(seed)
    words = "ida uwe ole klein gross lang kurz neu alt a b aaaa aaaaaaa são".split()
    out = []
    for _ in range(n):
        text = list(" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))))
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = rng.choice("aeioxyz ")
        out.append("".join(text))
    return out


def audit_of(spark, keys, **options):
    df = spark.createDataFrame(list(enumerate(keys)), "id long, name string").repartition(3)
    audit = dedup_fuzzy(df, ["name"], id_col="id", **options).audit
    return [tuple(r) for r in audit.orderBy("group_id").collect()]


@pytest.mark.parametrize(
    ("threshold", "leaders"), [(0, 512), (60, 3), (75, 2), (85, 512), (85, 3), (92, 2), (100, 4), (85, 1)]
)
def test_same_as_the_definition(spark, threshold, leaders):
    names = some_names(150, threshold)
    got = audit_of(spark, names, threshold=threshold, leaders=leaders, rows_per_task=20)
    assert got == by_definition(names, threshold, 1)


@pytest.mark.parametrize("block_size", [0, 2])
def test_block_size(spark, block_size):
    names = some_names(120, 5)
    assert audit_of(spark, names, threshold=80, block_size=block_size) == by_definition(names, 80, block_size)


def test_custom_scorer_sees_candidate_then_representative(spark):
    def prefix(candidate, representative):
        return 100.0 * candidate.startswith(representative)

    names = ["ab", "abc", "a", "abcd", "ad", "x", "xy"]
    assert audit_of(spark, names, scorer=prefix, leaders=2) == by_definition(names, 85, 1, prefix)


def test_accents_word_order_and_blocks(spark):
    assert audit_of(spark, ["João Reis", "joao reis", "Nora"]) == [
        (1, "fuzzy", "joão reis", 0, "1", 1)
    ]
    assert len(audit_of(spark, ["Nora Lund Berg", "Nora Berg Lund"], threshold=90)) == 1
    assert audit_of(spark, ["Nora Lund", "Lund Nora"], threshold=90) == []
    assert audit_of(spark, ["ora", "ara"], threshold=50) == []


def test_wrong_arguments(spark):
    df = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(ColumnNotFoundError):
        dedup_fuzzy(df, ["nope"])
    with pytest.raises(InvalidConfigError):
        dedup_fuzzy(df, ["name"], threshold=101)
    with pytest.raises(InvalidConfigError):
        dedup_fuzzy(df, ["name"], scorer="nope")


@pytest.mark.parametrize("threshold", [40, 70, 85, 93])
@pytest.mark.parametrize("tile_rows", [4, 2000])
def test_similar_pairs_are_complete(spark, threshold, tile_rows):
    texts = sorted(set(some_names(120, threshold)))
    nodes = spark.createDataFrame(
        [("x", i, t) for i, t in enumerate(texts)], "block string, node long, text string"
    )
    got = rows_of(similar_pairs(nodes, threshold, tile_rows))
    want = [
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if 200 * lcs(texts[i], texts[j]) >= threshold * (len(texts[i]) + len(texts[j]))
    ]
    assert got == sorted(want, key=str)


_text = st.text(alphabet="abc é", max_size=14)


@settings(max_examples=300, deadline=None)
@given(_text, _text, st.integers(30, 99))
def test_matching_texts_share_a_signature(a, b, threshold):
    if a and b and 200 * lcs(a, b) >= threshold * (len(a) + len(b)):
        q = gram_size(threshold)
        rank = {"a": 3, "ab": 2, "abc": 1, "\x01a": 4}
        assert set(signature(a, threshold, q, rank)) & set(signature(b, threshold, q, rank))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=90), st.text(max_size=90)), min_size=1, max_size=8))
def test_lcs(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in pairs]


def test_empty_texts_score_100():
    assert np.allclose(indel_ratios(["", "", "ab"], ["", "a", "ab"]), [100.0, 0.0, 100.0])


@pytest.mark.parametrize("rounds", [2, 100])
def test_representatives_of_chains_and_random_graphs(spark, rounds):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(25)]
    edges += sorted({tuple(sorted(rng.sample(range(100, 140), 2))) for _ in range(60)})
    matches = np.zeros((140, 140), bool)
    for a, b in edges:
        matches[b, a] = True
    owner = representatives(matches)
    want = [(i, int(rep)) for i, rep in enumerate(owner) if i != rep]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert rows_of(first_representatives(df, rounds)) == sorted(want, key=str)


def test_large_block_switches_to_signatures(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(150)})
    texts += [t[:4] + "z" + t[5:] for t in texts[::7]]
    nodes = spark.createDataFrame(
        [("x", i, t) for i, t in enumerate(texts)], "block string, node long, text string"
    )
    got = rows_of(assign_representatives(nodes, SCORERS["ratio"], 85, leaders=5, rows_per_task=30))
    matches = np.array([[200 * lcs(a, b) >= 85 * (len(a) + len(b)) for b in texts] for a in texts])
    owner = representatives(matches)
    want = [(i, int(rep)) for i, rep in enumerate(owner) if i != rep]
    assert got == sorted(want, key=str) and want


def test_leaders_of_one_lose_nothing(spark):
    assert audit_of(spark, ["abcdefgh", "abcdefgx", "abcdefgh"], threshold=80, leaders=1) == [
        (1, "fuzzy", "abcdefgh", 0, "1,2", 2)
    ]
    with pytest.raises(InvalidConfigError):
        audit_of(spark, ["a"], leaders=0)


def test_scorers_as_column_expressions(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def ratio(a, b):
        longer = max(len(a), len(b))
        return 100.0 * (longer - edits(a, b)) / longer if longer else 100.0

    names = some_names(120, 31)
    assert audit_of(spark, names, threshold=75, scorer="levenshtein_ratio") == by_definition(names, 75, 1, ratio)
    shorter = column_scorer(lambda candidate, rep: F.when(F.length(candidate) <= F.length(rep), 100.0).otherwise(0.0))
    want = by_definition(names, 50, 1, lambda a, b: 100.0 * (len(a) <= len(b)))
    assert audit_of(spark, names, threshold=50, scorer=shorter) == want


def test_pair_join_carries_no_texts(spark):
    nodes = spark.createDataFrame(
        [("x", i, t) for i, t in enumerate(some_names(40, 3))], "block string, node long, text string"
    )
    plan = similar_pairs(nodes, 85)._jdf.queryExecution().optimizedPlan().toString()
    # everything below the distinct pairs works on numbers
    assert "Aggregate" in plan and "text" not in plan[plan.index("Aggregate"):].split("LogicalRDD")[0].split("Join")[1]


@pytest.mark.parametrize("scorer", ["token_sort_ratio", "ratio"])
def test_long_texts_through_the_signatures(spark, scorer):
    rng = random.Random(77)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(500)]
    texts = []
    for _ in range(7):
        base = [rng.choice(words) for _ in range(rng.randrange(45, 75))]
        for hurt in (0, 2, 15, 35):
            own = list(base)
            for _ in range(hurt):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append("x " + " ".join(own))
    rng.shuffle(texts)

    def ratio(a, b):
        return 200.0 * lcs(a, b) / (len(a) + len(b))

    score = {"token_sort_ratio": token_sort_ratio, "ratio": ratio}[scorer]
    # three leaders a block: all other rows go through the signature join
    got = audit_of(spark, texts, threshold=85, scorer=scorer, leaders=3, rows_per_task=20)
    assert got == by_definition(texts, 85, 1, score) and len(got) >= 5


def long_texts(n, seed):
    """Texts of some hundred characters over few letters, in families of near copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 4 == 0:
            base = [rng.choice("abcd ") for _ in range(rng.choice([70, 90, 200, 260, 400]))]
        text = list(base)
        for _ in range(rng.randrange(len(text) // 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice("abcde ") * rng.randrange(2)
        out.append("".join(text))
    return out


def test_ratios_that_stop_early_decide_alike():
    texts = [*long_texts(60, 1), "", "a", "a" * 500, "ab" * 300]
    for threshold in (1, 50, 70, 85, 97, 100):
        for other in texts[::5]:
            want = indel_ratios(texts, [other] * len(texts)) >= threshold
            assert (indel_reaches(texts, other, threshold) == want).all()


@pytest.mark.parametrize("threshold", [70, 85, 100])
def test_texts_without_rare_grams_meet_by_length(spark, threshold):
    texts = sorted({*long_texts(90, 2), "", "a", "b"})
    nodes = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "block string, node long, text string").repartition(3)
    want = sorted(
        (i, j) for j in range(len(texts)) for i in np.flatnonzero(indel_ratios(texts[:j], [texts[j]] * j) >= threshold).tolist()
    )
    for tile_rows in (500, 5):
        assert sorted(map(tuple, pairs_of_like_length(nodes, threshold, tile_rows).collect())) == want
    # all of them have fewer different grams than they may lose
    assert sorted(map(tuple, similar_pairs(nodes, threshold).collect())) == want


def test_batch_scorer_is_the_loop_in_few_jobs(spark):
    def same_start(a, b):
        return pa.array([None if x == "" else 100.0 * x.startswith(y) for x, y in zip(a.to_pylist(), b.to_pylist())])

    def one(candidate, representative):
        return 100.0 * (candidate != "" and candidate.startswith(representative))

    names = ["ab", "abc", "a", "abcd", "ad", "x", "xy", "", "xyz", *some_names(40, 9)]
    assert audit_of(spark, names, scorer=batch_scorer(same_start), block_size=0) == by_definition(names, 85, 0, one)

    def jobs(rows):
        df = spark.range(rows).select("id", F.concat(F.lit("x"), F.col("id") % 1000).alias("name"))
        spark.sparkContext.setJobGroup(f"rows {rows}", "")
        scorer = batch_scorer(same_start, equal_texts_match=True)
        dedup_fuzzy(df, ["name"], scorer=scorer, id_col="id", block_size=0).audit.collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rows {rows}"))

    assert abs(jobs(150) - jobs(1500)) <= 6


def test_queries_on_whole_texts_are_the_loop(spark, tmp_path):
    """These two have no SQL: the recursion is too slow on whole texts."""
    texts = [*long_texts(60, 3), *some_names(20, 4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(i // 7, i % 7, t) for i, t in rows]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = [(n, m, hashlib.md5(k.encode()).hexdigest(), *rest) for n, m, k, *rest in by_definition(texts, 85, 1)]
    assert len(want) > 5
    for query in (dedup_fuzzy_documents, dedup_fuzzy_conversations):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == want
