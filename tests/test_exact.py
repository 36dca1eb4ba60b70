import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from kindred.errors import CleaningError, ColumnNotFoundError, InvalidConfigError
from kindred.operators.audit import AUDIT_COLUMNS, audit_members, summary, union_audits
from kindred.operators.clean import clean_table
from kindred.operators.exact import dedup_exact


def expected(keys):
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    return [
        (n, "exact", ids[0], ",".join(map(str, ids[1:])), len(ids) - 1)
        for n, ids in enumerate((g for g in groups.values() if len(g) > 1), 1)
    ]


def test_two_keys(spark):
    df = spark.createDataFrame(
        [("Ida", "Bonn"), ("Uwe", "Kiel"), ("Ida", "Bonn")], "name string, city string"
    )
    out = dedup_exact(df, ["name", "city"])
    assert out.audit.columns == AUDIT_COLUMNS
    assert out.audit.collect() == [(1, "exact", "Ida | Bonn", 0, "2", 1)]
    assert rows_of(out.clean, "name") == [("Ida",), ("Uwe",)]


def test_first_row_wins_and_other_columns_do_not_count(spark):
    df = spark.createDataFrame([("Ida", "first"), ("Ida", "second")], "name string, note string")
    assert dedup_exact(df, ["name"]).clean.select("note").collect() == [("first",)]


def test_null_is_empty_but_keys_do_not_run_together(spark):
    df = spark.createDataFrame(
        [(None, "q"), ("", "q"), ("a | b", "c"), ("a", "b | c")], "x string, y string"
    )
    out = dedup_exact(df, ["x", "y"])
    assert rows_of(out.audit) == [(1, "exact", " | q", 0, "1", 1)]


def test_no_duplicates(spark):
    df = spark.createDataFrame([("Ida",), ("Uwe",)], "name string")
    out = dedup_exact(df, ["name"])
    assert (out.clean.count(), out.audit.count(), out.audit.columns) == (2, 0, AUDIT_COLUMNS)


def test_missing_key(spark):
    df = spark.createDataFrame([("Ida",)], "name string")
    with pytest.raises(ColumnNotFoundError):
        dedup_exact(df, ["nope"])
    with pytest.raises(CleaningError):
        dedup_exact(df, [])


@pytest.mark.parametrize("parts", [1, 5])
def test_random_keys_any_partitioning(spark, parts):
    rng = random.Random(11)
    keys = ["hot" if rng.random() < 0.34 else str(rng.randrange(60)) for _ in range(300)]
    rows = list(enumerate(keys))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k string").repartition(parts)
    out = dedup_exact(df, ["k"], id_col="id")
    got = out.audit.orderBy("group_id").drop("key").collect()
    assert [tuple(r) for r in got] == expected(keys)
    s = summary(df, out.clean).first()
    assert s.n_in - s.n_out == s.n_removed == sum(r.n_duplicates for r in got)
    assert rows_of(audit_members(out.audit)) == rows_of(out.members)


def test_one_row_per_group_whatever_its_size(spark):
    df = spark.range(0, 150_000).withColumn("k", F.when(F.col("id") < 149_990, "k").otherwise("l"))
    out = dedup_exact(df, ["k"], id_col="id")
    audit = out.audit.orderBy("group_id").collect()
    assert [(r.group_id, r.n_duplicates) for r in audit] == [(1, 149_989), (2, 9)]
    assert audit[0].removed_indices.count(",") == 149_988
    assert out.members.where("group_id = 1").count() == 149_989


def test_ids_must_be_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "b")], "id long, k string")
    with pytest.raises(InvalidConfigError, match="null|more than once"):
        dedup_exact(df, ["k"], id_col="id")
    with pytest.raises(InvalidConfigError, match="more than once"):
        dedup_exact(df.where("id is not null"), ["k"], id_col="id")
    assert dedup_exact(df.where("id = 2"), ["k"], id_col="id", trusted=True).clean.count() == 1


def test_order_by_says_which_row_is_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, day int").repartition(3)
    assert rows_of(dedup_exact(df, ["k"], order_by="day").clean, "k", "day") == [("a", 1), ("b", 2)]
    assert rows_of(clean_table(df, {"keys": ["k"]}, order_by="day").clean, "k", "day") == [("a", 1), ("b", 2)]


def test_plan_shuffles_digests_not_texts(spark):
    df = spark.createDataFrame([(1, "a" * 50), (2, "b")], "id long, text string")
    plan = dedup_exact(df, ["text"], id_col="id").members._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_stages_number_on_and_keep_ids(spark):
    df = spark.createDataFrame(
        [(10, " Ida Klein"), (11, "ida klein"), (12, "ida kleim"), (13, "uwe")], "id long, name string"
    )
    config = {"keys": ["name"], "normalize": {"name": ["trim", "lowercase"]},
              "mode": "Exact then Fuzzy", "threshold": 85}
    out = clean_table(df, config, id_col="id")
    assert rows_of(out.audit) == [
        (1, "exact", "ida klein", 10, "11", 1), (2, "fuzzy", "ida klein", 10, "12", 1)
    ]
    assert rows_of(out.clean, "id") == [(10,), (13,)]


def test_union_of_audits(spark):
    a = spark.createDataFrame([(1, "exact", "k", 0, "1", 1)],
                              "group_id long, method string, key string, kept_index long, "
                              "removed_indices string, n_duplicates long")
    b = a.selectExpr("*", "0.9D AS match_probability")
    assert rows_of(union_audits(a, b), "match_probability") == [(0.9,), (None,)]


def test_staged_run_reads_the_first_stage_once(spark):
    """Whole rows meet what both stages removed in one anti join; the stage between is written."""
    df = spark.range(40).selectExpr("id", "concat('name ', id div 4, repeat('x', cast(id % 4 = 3 as int))) as k", "id as v")
    out = clean_table(df, {"keys": ["k"], "mode": "Exact then Fuzzy", "threshold": 90}, id_col="id")
    plan = out.clean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    kept = {r.id for r in out.clean.collect()}
    members = [r.removed_index for r in out.members.collect()]
    assert len(members) == len(set(members)) and kept | set(members) == set(range(40)) and not kept & set(members)
    assert {"id", "k", "v"} <= set(out.clean.columns)
