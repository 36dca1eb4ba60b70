import numpy as np
import pytest

from kindred.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "c") for i, v in rows], SCHEMA)


def brute(vectors, k):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    white = (x - sums / n) @ axes[:, order] / np.sqrt(values[order])
    return n, ((n * x - sums) ** 2).sum(axis=1), white, values[order] / values.sum()


def test_counts_are_the_number_of_eigenvalues_above():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 9, 30):
        for kind in range(3):
            a = rng.normal(size=(d, d))
            a = a + a.T
            if kind == 1:
                a[np.diag_indices(d)] = 0  # every single pivot is zero at first
            if kind == 2:
                a = a @ a
            values = np.linalg.eigvalsh(a)
            for shift in (*((values[:-1] + values[1:]) / 2), values[0] - 1, values[-1] + 1, 0.0123):
                assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.zeros((4, 4)), 0.0) == 0


def test_components_of_near_and_equal_eigenvalues():
    rng = np.random.default_rng(2)
    for spectrum in ([9, 8, 7, 6, 1, 0], [5, 5, 5, 1, 1, 1], [3, 3 - 1e-9, 3 - 2e-9, 1, 0, 0], [1e12, 1, 1e-3, 0, 0, 0], [2, 2, 2, 2, 2, 2]):
        q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        found = whitening.leading_components(a, 4)
        want = [v for v in spectrum[:4] if v > 1e-13 * 6 * max(spectrum)]
        assert len(found) == len(want)
        assert np.allclose([c.value for c in found], want, rtol=1e-9, atol=1e-9 * max(spectrum) * 1e-4)
        vectors = np.array([c.vector for c in found])
        assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
        assert np.abs(a @ vectors.T - vectors.T * [c.value for c in found]).max() < 1e-13 * max(spectrum) * 10
    assert whitening.leading_components(np.zeros((3, 3)), 2) == []


def test_whole_number_products_are_exact():
    rng = np.random.default_rng(3)
    for reach in (5, 2**19, 2**20, 2**33, 2**51):
        y = rng.integers(-reach, reach + 1, (50, 3))
        want = np.array([[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)], object)
        assert (whitening._products(y, reach) == want).all()


def test_against_eigh(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 8)) * [3, 2, 1.5, 1.2, 0.5, 0.4, 0.3, 0.2] + 100
    vectors = [*base, *base[:40]]  # repeated rows count once in the fit
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [np.nan] * 8), (903, [None] * 8), (904, [np.inf] * 8), (905, [1, None] * 4)]
    got = whitening.whiten(table(spark, rows)).collect()
    n, deviation, white, explained = brute(vectors, 4)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(4):
        mine = np.array([by[i, c + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-9
        assert abs(by[0, c + 1].explained - explained[c]) < 1e-12
    assert [int(by[i, 1].deviation) for i in range(len(vectors))] == deviation.tolist()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_large_entries_ids_and_degenerate_tables(spark):
    far = [(i, [1e12 + 65536.0 * i, (-1) ** i * 3e11]) for i in range(6)]
    got = whitening.whiten(table(spark, far)).collect()
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in far]
    n = len({tuple(r) for r in x})
    sums = [sum(c) for c in zip(*{tuple(r) for r in x})]
    assert {int(r.deviation) for r in got} == {sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x}
    one = [(1, [0.5, 0.25]), (None, [0.5, 0.25])]
    assert whitening.whiten(table(spark, one)).count() == 0
    line = [(1, [0.5, 0.25]), (None, [0.75, 0.25]), (1, [0.5, 0.25])]
    rows = whitening.whiten(table(spark, line)).collect()
    assert sorted((r.vec_id or 0, round(abs(r.whitened), 9), r.component) for r in rows) == [(0, 1, 1), (1, 1, 1), (1, 1, 1)]
    assert whitening.whiten(table(spark, one).limit(0)).count() == 0
    with pytest.raises(Exception, match="different numbers"):
        whitening.whiten(table(spark, [(1, [1]), (2, [1, 2])])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30]), (2, [1])])).collect()
