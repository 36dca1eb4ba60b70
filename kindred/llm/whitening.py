"""Whitening of embeddings on leading principal components found by spectrum slicing.

Entries become whole numbers, x = floor(scale * c). Sums and products of the distinct vectors are
added up in whole numbers, products of entries that are centred first, so the covariance is exact
but for one last rounding and equal on every run. The number of positive pivots in LDL^T of the
shifted covariance is the number of eigenvalues above the shift (Sylvester's law of inertia).
Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient iteration closes in
on it cubically, and two more counts, just above and just below, certify its number.

Spark reads the vectors; the driver sees sums: the means and one square matrix of as many rows as
a vector has entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from kindred.llm.common import col, written

SEED = 11
# whole numbers are multiplied as digits of so many bits: products of _ROWS of them stay exact in a double
_BITS = 20
_ROWS = 8192
_LARGEST = 2.0**52  # entries from here on are no longer whole numbers told apart by a double
_PIVOT = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of LDL^T of matrix - shift.

    Bunch and Parlett's choice of pivots, one or two rows at a time, keeps all entries bounded; a
    pair of rows taken together always has one positive and one negative eigenvalue. A pivot of
    exactly zero belongs to an eigenvalue at the shift and doesn't count.
    """
    a = np.array(matrix, float)
    a[np.diag_indices_from(a)] -= shift
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= _PIVOT * off[r, s]:
            pivot = a[p, p]
            if pivot == 0:
                break  # nothing is left but zeros
            above += pivot > 0
            column = np.delete(a[:, p], p)
            a = np.delete(np.delete(a, p, 0), p, 1) - np.outer(column, column / pivot)
        else:
            above += 1
            both = [r, s]
            block, columns = a[np.ix_(both, both)], np.delete(a[:, both], both, 0)
            a = np.delete(np.delete(a, both, 0), both, 1) - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return above


@dataclass(frozen=True)
class Component:
    value: float
    vector: np.ndarray


def _slice(matrix: np.ndarray, k: int, low: float, high: float, steps: int, alone: bool) -> tuple[float, float]:
    """Halve (low, high], which holds the k-th largest eigenvalue, ``steps`` times, or until it holds
    no other one if ``alone`` says so. It keeps holding it."""
    above_low, above_high = (count_above(matrix, s) for s in (low, high))
    for _ in range(steps):
        middle = (low + high) / 2
        if alone and (above_low, above_high) == (k, k - 1) or not low < middle < high:
            break
        above = count_above(matrix, middle)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, high


def _without(vector: np.ndarray, found: list[Component]) -> np.ndarray:
    for _ in range(2):  # the second time takes out what rounding left
        for c in found:
            vector = vector - (c.vector @ vector) * c.vector
    return vector / np.linalg.norm(vector)


def _quotient_iteration(matrix: np.ndarray, shift: float, vector: np.ndarray, found: list[Component]):
    """Value, vector and residual that Rayleigh quotient iteration ends at, after two steps of
    inverse iteration at ``shift``; across the vectors already found."""
    best = (shift, vector, np.inf)
    eye, size = np.eye(len(matrix)), np.abs(matrix).sum(axis=1).max()
    for step in range(30):
        try:
            solved = np.linalg.solve(matrix - shift * eye, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            solved = np.linalg.solve(matrix - (shift + size * 1e-15) * eye, vector)
        if not np.isfinite(solved).all() or not solved.any():
            break
        vector = _without(solved, found)
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if step > 2 and residual >= best[2]:
            break
        best = (value, vector, residual)
        if step > 0:
            shift = value
    return best


def leading_components(matrix: np.ndarray, count: int) -> list[Component]:
    """The ``count`` largest eigenvalues above zero of a symmetric matrix without negative ones, with
    unit eigenvectors, by falling eigenvalue. Equal eigenvalues have orthogonal vectors.

    The counts just above and just below a value must agree with its number. If they don't, the
    iteration has ended at another eigenvalue, and starts again from a narrower interval.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    floor = size * d * 1e-14  # below it an eigenvalue is rounding
    out: list[Component] = []
    rng = np.random.default_rng(SEED)
    for k in range(1, min(count, d) + 1):
        if size == 0 or count_above(matrix, floor) < k:
            break
        low, high = _slice(matrix, k, 0.0, size * (1 + 1e-12), 60, True)
        while True:
            start = _without(rng.normal(size=d), out)
            value, vector, residual = _quotient_iteration(matrix, (low + high) / 2, start, out)
            margin = max(8 * residual, size * 1e-14)
            if margin < size * 1e-9 and count_above(matrix, value + margin) < k <= count_above(matrix, value - margin):
                break
            if high - low <= size * 1e-15:
                raise ArithmeticError("The counts don't confirm the number of an eigenvalue.")
            low, high = _slice(matrix, k, low, high, 4, False)
        out.append(Component(value, vector))
    # values equal but for rounding may have come in the other order
    return sorted(out, key=lambda c: -c.value)


def _numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows that take part."""
    vec = col(vector_col).cast("array<double>")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # exists() is null where an entry is null and no other one is true
    takes_part = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda c: c.isNull()) & ~F.coalesce(bad, F.lit(True))
    whole = F.transform(vec, lambda c: F.when(
        F.abs(c * scale) < _LARGEST, F.floor(c * scale)
    ).otherwise(F.raise_error(F.lit("An entry is too large to become a whole number.")).cast("long")))
    return vectors.where(takes_part).select(col(id_col).alias("vec_id"), whole.alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _products(y: np.ndarray, reach: int) -> list[list[int]]:
    """y.T @ y in whole numbers, for entries of at most ``reach``."""
    digits, rest = [], y.astype(np.int64)
    for _ in range(max(1, -(-reach.bit_length() // _BITS))):
        digits.append((rest & ((1 << _BITS) - 1)).astype(float))
        rest = rest >> _BITS
    digits[-1] += (rest << _BITS).astype(float)  # the sign
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            part = np.zeros(total.shape, np.int64)
            for start in range(0, len(y), _ROWS):
                part += (a[start : start + _ROWS].T @ b[start : start + _ROWS]).astype(np.int64)
            total += part.astype(object) << (_BITS * (i + j))
    return total


def _added(rows: DataFrame, dims: int, count: int, partial) -> np.ndarray:
    """Sums over all rows of the ``count`` whole numbers that ``partial`` makes of a matrix of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, object)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch, dims))
        text = pa.array([str(v) for v in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), text], ["at", "total"])

    sums = rows.select("x").mapInArrow(run, "at int, total string")
    sums = sums.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = np.zeros(count, object)
    for r in sums:
        out[r["at"]] = int(r["total"])
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: its size, sums per dimension, the covariance and its components."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: list[Component]

    @property
    def explained(self) -> list[float]:
        trace = float(np.trace(self.covariance))
        return [c.value / trace for c in self.components]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, one column per component."""
        mean = np.array([s / self.n for s in self.sums])
        axes = np.array([c.vector / np.sqrt(c.value) for c in self.components])
        return (x - mean) @ axes.T


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """``distinct``: a written table of each vector once, in column x. None if it is empty."""
    sizes = distinct.groupBy(F.size("x").alias("dims")).count().limit(2).collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("Vectors have different numbers of entries.")
    dims, n = sizes[0]["dims"], sizes[0]["count"]
    sums = _added(distinct, dims, dims, lambda x: x.sum(axis=0, dtype=object) if np.abs(x).max() > 2**40 else x.sum(axis=0).astype(object))
    centre = np.array([int(s) // n for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = x - centre
        first = y.astype(object).sum(axis=0) if np.abs(y).max() > 2**40 else y.sum(axis=0).astype(object)
        return np.concatenate([first, _products(y, int(np.abs(y).max())).ravel()])

    both = _added(distinct, dims, dims + dims * dims, products)
    first, second = both[:dims], both[dims:].reshape(dims, dims)
    # what the whole-number centre leaves of the mean is taken out in whole numbers too
    square = n * n
    covariance = np.array(
        [[(n * int(second[i, j]) - int(first[i]) * int(first[j])) / square for j in range(dims)] for i in range(dims)]
    )
    return Whitening(n, [int(s) for s in sums], covariance, leading_components(covariance, components))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row
    that takes part and every component up to ``components``.

    Entries become x = floor(scale * entry). The fit list is each distinct x once (n of them, with
    sums S per dimension); covariances are over it, with divisor n. ``deviation`` is the sum over
    dimensions of (n x - S)^2, as decimal(38,0), so that it stays exact for very long tables.
    ``whitened`` is the projection of x - S/n on the component over the root of its eigenvalue.
    ``explained`` is the eigenvalue's share of the trace. ``identity_error`` is the largest absolute
    entry of the covariance of the whitened values minus the identity.

    Rows whose vector is null, empty or holds null or non-finite entries take no part. Null and
    repeated ids stay, one set of result rows for each row; equal vectors count once in the fit. Components
    whose eigenvalue is zero can't be whitened and are left out, so a table with a single vector, and an
    empty one, give no rows. Vectors of different lengths and entries of 2^52 / scale or more raise an
    error. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = ("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = _numbers(vectors, scale, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    distinct = written(rows.select("x").distinct())
    model = fit(distinct, components)
    if model is None or not model.components:
        return spark.createDataFrame([], f"vec_id {id_type}, {schema}")
    dims, n, k = len(model.sums), model.n, len(model.components)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = model.project(_matrix(batch, dims))
                yield pa.RecordBatch.from_arrays([pa.array(values[:, i]) for i in range(k)], [f"w{i}" for i in range(k)])

    # covar_pop keeps running means, so it centres before it multiplies
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    moments = distinct.select("x").mapInArrow(projected, ", ".join(f"w{i} double" for i in range(k))).agg(
        *(F.covar_pop(f"w{i}", f"w{j}").cast(DoubleType()).alias(f"m{i}_{j}") for i, j in pairs)
    ).first()
    identity_error = max(abs(moments[f"m{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = np.array(model.explained)
    sums = np.array(model.sums, object)

    def deviations(x: np.ndarray) -> pa.Array:
        # a bound on the result says whether 64 bits can hold it
        reach = max(abs(n * int(v) - s) for v in (x.min(), x.max()) for s in (min(model.sums), max(model.sums)))
        if dims * reach * reach < 2**63:
            off = n * x - sums.astype(np.int64)
            return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
        off = n * x.astype(object) - sums
        return pa.array([int(v) for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims)
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)), deviations(x).take(each), pa.array(model.project(x).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(result, f"vec_id {id_type}, {schema}")
