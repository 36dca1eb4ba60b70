import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import ColumnNotFoundError, InvalidConfigError
from kindred.plans.ids import number_rows, with_row_id
from kindred.plans.pairs import join_pairs, pair_forecast


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((999 - F.col("id")).alias("v"))
    out = number_rows(df, ["v"], "n", start=1)
    assert sorted((r.v, r.n) for r in out.collect()) == [(i, i + 1) for i in range(1000)]


def test_numbers_do_not_move_under_a_filter(spark):
    df = spark.range(0, 100, 1, 5).withColumn("v", F.col("id") % 7)
    out = with_row_id(df, order_by="id").where("v = 3")
    assert all(r._row_id == r.id for r in out.collect())


def test_natural_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert [(r._row_id, r.v) for r in with_row_id(df).orderBy("_row_id").collect()] == [
        (0, "a"), (1, "b"), (2, "c")
    ]


def test_id_column_is_checked(spark):
    df = spark.createDataFrame([("a", 5)], "v string, k int")
    assert with_row_id(df, id_col="k").first()._row_id == 5
    with pytest.raises(ColumnNotFoundError):
        with_row_id(df, id_col="nope")
    with pytest.raises(InvalidConfigError):
        with_row_id(df, id_col="v")


def test_reserved_names(spark):
    df = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "_row_id long, _pos int, _part int")
    with pytest.raises(InvalidConfigError, match="already has"):
        with_row_id(df)
    assert {r._row_id for r in with_row_id(df, id_col="_row_id").collect()} == {7, 8}
    out = with_row_id(df.withColumnRenamed("_row_id", "k"))
    assert {(r.k, r._pos, r._part) for r in out.collect()} == {(7, 1, 2), (8, 1, 3)}


def test_intermediate_results_can_be_dropped(tmp_path):
    import subprocess
    import sys

    code = """
import os, sys
from pyspark.sql import SparkSession
from kindred.plans.cut import cut_lineage, drop_intermediate
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert cut_lineage(spark.range(5)).count() == 5
assert any(files for _, _, files in os.walk(sys.argv[1]))
drop_intermediate(spark)
assert not any(files for _, _, files in os.walk(sys.argv[1]))
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, capture_output=True, timeout=120,
                   cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("tile_rows", [3, 1000])
def test_tiles_make_each_pair_once(spark, tile_rows):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice("abcdef")) for i in range(60)]
    other = [(i, "hot" if rng.random() < 0.4 else rng.choice("abcdxy")) for i in range(50)]
    left = spark.createDataFrame(rows, "l long, k string")
    right = spark.createDataFrame(other, "r long, k string")
    got = [(p.l, p.r) for p in join_pairs(left, right, ["k"], "l", "r", tile_rows=tile_rows).collect()]
    want = [(a, b) for (a, x), (b, y) in itertools.product(rows, other) if x == y]
    assert sorted(got) == sorted(want)
    both = join_pairs(left, left.withColumnRenamed("l", "r"), ["k"], "l", "r", True, tile_rows)
    got = [(p.l, p.r) for p in both.where("l < r").collect()]
    want = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x == y]
    assert sorted(got) == sorted(want)


def test_forecast_counts_pairs(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",), (None,)], "k string")
    assert {(r.k, r.n_rows, int(r.n_pairs)) for r in pair_forecast(df, "k").collect()} == {
        ("a", 4, 6), ("b", 1, 0)
    }
