import random

import pytest
from conftest import rows_of

from kindred.operators.cluster import connected_components


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return sorted(((n, find(n)) for n in root), key=str)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "cycle"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80, 160)) for _ in range(70)],
        "chain": [(i + 1, i) for i in range(40)],
        "star": [(99, i) for i in range(60)],
        "cycle": [(i, (i + 1) % 20) for i in range(20)] + [(5, 5)],
    }[shape]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert rows_of(connected_components(df)) == union_find([e for e in edges if e[0] != e[1]])


def test_vertices_without_edges_are_components(spark):
    edges = spark.createDataFrame([(2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (9,), (9,)], "node long")
    assert rows_of(connected_components(edges, nodes)) == [(1, 1), (2, 2), (3, 2), (9, 9)]
    none = edges.where("src > 5")
    assert rows_of(connected_components(none, nodes)) == [(1, 1), (2, 2), (3, 3), (9, 9)]


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
