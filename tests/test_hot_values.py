import random
from collections import Counter
from itertools import combinations, product

from kindred.config import LinkConfig
from kindred.linkage.candidates import candidate_pairs
from kindred.linkage.hot import frequent_values, value_pairs, without_frequent
from kindred.linkage.records import merge_copies, record_rows
from kindred.linkage.train import blocked_patterns, train
from kindred.plans.ids import with_row_id

SCHEMA = "id long, city string, kind string, colour string, day string, name string"


def people(spark, n, seed, hot=0.6):
    rng = random.Random(seed)
    rows = [
        (
            i, "Metropolis" if rng.random() < hot else rng.choice([None, f"town{rng.randrange(n // 3)}"]), rng.choice(["a", "b", "c", None]),
            rng.choice(["red", "blue", None]), rng.choice(["2020-01-01", "2020-01-15", "2021-06-01", "no day", None]), f"name {rng.randrange(12)}",
        )
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def records(df, config):
    return merge_copies(record_rows(with_row_id(df, id_col="id"), config))


def day_level(a, b):
    from datetime import date

    def day(x):
        return None if x == "no day" else date.fromisoformat(x)

    if a is None or b is None or day(a) is None or day(b) is None:
        return -1
    if a == b:
        return 5
    days = abs((day(a) - day(b)).days)
    one_edit = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    return 4 if one_edit else 3 if days <= 30.4375 else 2 if days <= 365.25 else 1 if days <= 3652.5 else 0


def plain_patterns(pairs, config):
    at = {name: i for i, name in enumerate(["id", "city", "kind", "colour", "day", "name"])}
    out = Counter()
    for a, b in pairs:
        equal = [a[at[c]] is not None and a[at[c]] == b[at[c]] for c in config.blocking_columns]
        if not any(equal):
            continue
        gamma = []
        for c, kind in config.comparisons.items():
            x, y = a[at[c]], b[at[c]]
            gamma.append(day_level(x, y) if kind == "date" else -1 if x is None or y is None else int(x == y))
        out[sum(1 << j for j, e in enumerate(equal) if e), *gamma] += 1
    return out


def patterns(left, right, config):
    names = ["agree", *(f"gamma_{i}" for i in range(len(config.comparisons)))]
    found = blocked_patterns(left, right, config).collect()
    out = {tuple(r[c] for c in names): int(r["pairs"]) for r in found}
    assert len(out) == len(found)
    return out


CONFIGS = (
    LinkConfig({"city": "exact", "kind": "exact", "colour": "exact"}),
    LinkConfig({"city": "exact", "day": "date", "colour": "exact"}, blocking=("kind", "city", "day")),
)


def test_patterns_are_those_of_all_pairs(spark):
    rows, df = people(spark, 400, 1)
    for config in CONFIGS:
        table = records(df, config)
        assert not frequent_values(table, None, config, least_rows=8).isEmpty()
        assert patterns(table, None, config) == plain_patterns(combinations(rows, 2), config)


def test_patterns_between_two_tables(spark):
    (rows_a, a), (rows_b, b) = people(spark, 300, 2), people(spark, 150, 3)
    for config in CONFIGS:
        assert patterns(records(a, config), records(b, config), config) == plain_patterns(product(rows_a, rows_b), config)


def test_a_value_on_a_third_of_the_rows_makes_no_pair(spark):
    config = LinkConfig({"city": "exact", "name": "exact", "id": "exact"}, blocking=("city", "name"))
    rng = random.Random(4)
    n = 6_000
    rows = [(i, "Metropolis" if i % 3 == 0 else f"town{rng.randrange(n // 2)}", None, None, None, f"name {rng.randrange(n // 3)}") for i in range(n)]
    table = records(spark.createDataFrame(rows, SCHEMA), config)
    frequent = frequent_values(table, None, config)
    assert [r["rule"] for r in frequent.collect()] == [0]
    cold = candidate_pairs(without_frequent(table, frequent, 2), None, 2, join_on="c").count()
    hot = value_pairs(table, None, frequent, config).where("t = 0").count()
    assert hot <= 1 and cold < 5 * n  # the 2,000 records of the value would make two million pairs
    found = patterns(table, None, config)
    assert sum(c for key, c in found.items() if key[0] & 1) >= 2_000 * 1_999 // 2
    assert found == plain_patterns(combinations(rows, 2), LinkConfig(config.comparisons, blocking=("city", "name")))
    model = train(table, record_rows(with_row_id(spark.createDataFrame(rows, SCHEMA), id_col="id"), config), None, None, config)
    assert 0 < model.prior < 1
