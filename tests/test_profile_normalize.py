import pytest
from conftest import rows_of

from kindred.errors import CleaningError, ColumnNotFoundError
from kindred.operators.normalize import normalize
from kindred.operators.profile import common_columns, preview, profile_columns, profile_summary, profile_table


@pytest.fixture
def ages(spark):
    return spark.createDataFrame(
        [("Dina", 41), ("Emil", 22), ("Dina", 41), (None, 57)], "name string, age long"
    )


def test_profile(ages):
    p = profile_table(ages)
    assert (p["n_rows"], p["n_cols"], p["columns"]) == (4, 2, ["name", "age"])
    assert p["dtypes"] == {"name": "string", "age": "bigint"}
    assert p["null_pct"] == {"name": 25.0, "age": 0.0}
    assert p["exact_duplicates"] == 1


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double")
    p = profile_table(empty)
    assert (p["n_rows"], p["exact_duplicates"], p["null_pct"]) == (0, 0, {"a": 0.0, "b": 0.0})


def test_nulls_are_equal_and_nan_is_missing(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, None), ("x", 1.0)], "a string, b double")
    assert profile_summary(df).first().exact_duplicates == 1
    assert {r.column: r.null_pct for r in profile_columns(df).collect()} == {"a": 66.67, "b": 66.67}


def test_rounding_is_half_even(spark):
    df = spark.range(800).selectExpr("CASE WHEN id >= 1 THEN 1 END AS v")  # 0.125 %
    assert profile_columns(df).first().null_pct == 0.12


def test_nested_columns_do_not_break_the_profile(spark):
    df = spark.sql("SELECT map('a', 1) m, array(1, 2) l, named_struct('x', 1) s FROM range(3)")
    assert profile_summary(df).first().exact_duplicates == 2


def test_strange_column_names(spark):
    df = spark.createDataFrame([(1, "a")], "`x.y` long, `b``c` string")
    assert profile_table(df)["null_pct"] == {"x.y": 0.0, "b`c": 0.0}
    assert normalize(df, {"b`c": ["trim"]}).columns == df.columns


@pytest.mark.parametrize(
    ("ops", "given", "wanted"),
    [
        (["trim"], "\t\n Zoe 　\r", "Zoe"),
        (["lowercase"], "ÉLAN", "élan"),
        (["email"], "  Zoe@Y.PT ", "zoe@y.pt"),
        (["phone"], "+49 (30) 12-34.5", "49301234" "5"),
        (["trim", "lowercase"], " A b ", "a b"),
        ([], None, ""),
        (["lowercase"], None, ""),
    ],
)
def test_normalize(spark, ops, given, wanted):
    df = spark.createDataFrame([(given, 7)], "v string, keep long")
    assert normalize(df, {"v": ops}).collect() == [(wanted, 7)]
    assert df.first().v == given


def test_normalize_checks_first(spark):
    df = spark.createDataFrame([("a",)], "v string")
    with pytest.raises(ColumnNotFoundError, match="Available"):
        normalize(df, {"w": ["trim"]})
    with pytest.raises(CleaningError, match="use one of"):
        normalize(df, {"v": ["shout"]})


def test_preview_and_common_columns(spark):
    df = spark.createDataFrame([(2, "b"), (0, "z"), (1, "y")], "_row_id long, v string")
    assert [r.v for r in preview(df, 2).collect()] == ["z", "y"]
    assert common_columns(df, spark.createDataFrame([("a", 1)], "v string, q int")) == ["v"]
    assert rows_of(df, "v") == [("b",), ("y",), ("z",)]
