import numpy as np
from pyspark.sql import functions as F

from kindred.llm import hilbert


def table(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    for name in ("point", "vec", "at", "rank", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute(ids, data, query, k=10):
    d = np.sqrt(((data - data[ids == query][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_curve_is_a_walk_over_all_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32))
    data = (centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 32)) * 0.6).astype(np.float32)
    ids = rng.permutation(4000)
    out = hilbert.nearest(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, data)]), block_rows=300).toPandas()
    exact = data.astype(np.float64)
    hits = total = 0
    for query, rows in out.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 11))
        want = dict(brute(ids, exact, query))
        hits += len(set(want) & set(rows["vec_id"]))
        total += 10
        d = np.sqrt(((exact[[np.flatnonzero(ids == v)[0] for v in rows["vec_id"]]] - exact[ids == query][0]) ** 2).sum(axis=1))
        assert np.allclose(rows["score"], d, rtol=1e-14) and (np.diff(rows["score"]) >= 0).all()
    assert total == 400 and hits / total >= 0.9


def test_an_offset_all_vectors_share_costs_nothing(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(600, 16))
    found = []
    for offset in (0.0, 1e8):
        data = spread + offset
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
        out = hilbert.nearest(df).toPandas()
        ids = np.arange(600)
        hits = [len({i for i, _ in brute(ids, data, q)} & set(g["vec_id"])) for q, g in out.groupby("query_id")]
        found.append(sum(hits))
    assert found == [60, 60]


def test_copies_ties_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]
    rows = [(i, one) for i in range(0, 130)] + [(200, two), (201, two), (300, None), (301, []), (302, [0.0] * 3),
            (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (305, [None, 1.0, 1.0]), (306, [1.0, 2.0]), (None, one), (0, one)]
    out = hilbert.nearest(table(spark, rows)).toPandas().sort_values(["query_id", "rank"])
    near = {q: g["vec_id"].tolist() for q, g in out.groupby("query_id")}
    assert near[0] == list(range(1, 11)) and near[100] == list(range(10))
    assert near[200] == [201, *range(9)]
    assert set(near) == {0, 100, 200}


def test_few_rows_and_none(spark):
    out = hilbert.nearest(table(spark, [(0, [1.0, 2.0]), (5, [2.0, 2.0]), (7, [9.0, 9.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out, key=lambda r: r.rank)] == [(0, 1, 5), (0, 2, 7)]
    assert hilbert.nearest(table(spark, [(0, [1.0])])).count() == 0
    assert hilbert.nearest(table(spark, [(0, [1.0])]).limit(0)).count() == 0
