"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors onto a few random orthonormal directions, shifts them, and orders
them by their place on a Hilbert curve there. Spark sorts each curve by range and numbers it, so
that neighbours on a curve lie in the same or in adjoining blocks. A query looks at the window
around its own place on every curve, block by block; the blocks' best are merged and ranked by the
exact distance of the original vectors.

The window is a share of the table on each side. In isotropic data of many dimensions the nearest
vectors are hardly nearer than the rest, and no smaller window keeps the recall; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kindred.llm.common import col, written
from kindred.plans.ids import number_rows

DIRECTIONS = 4
BITS = 15
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of non-negative numbers below 2**bits) on a Hilbert curve.

    Skilling's transform, for all rows at once; columns times bits must fit into 63.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            inverted = (x[:, i] & bit) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    bit = top
    while bit > 1:
        flip ^= np.where(x[:, dims - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_frames(dims: int, curves: int, directions: int = DIRECTIONS) -> np.ndarray:
    """Orthonormal directions of every curve: (curves, dims, directions). Curves that fit side by
    side into the space are orthogonal to each other."""
    rng = np.random.default_rng(SEED)
    directions = min(directions, dims)
    each = dims // directions
    frames: list[np.ndarray] = []
    while len(frames) < curves:
        base = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        frames += [base[:, i * directions : (i + 1) * directions] for i in range(each)]
    return np.stack(frames[:curves])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: vectors that are not null, not all
    zero, hold finite numbers only and have the most common length."""
    vec = col(vector_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(
        ~F.coalesce(F.exists(vec, lambda x: x.isNull()), F.lit(True)) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)
    )
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 16, window: float = 0.06,
            least_window: int = 256, block_rows: int = 4096, sample_rows: int = 10_000,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every query (ids divisible by ``every``): query_id, rank, vec_id,
    score (Euclidean distance in double precision), ties to the smaller id.

    On each curve a query sees the ``window`` share of all vectors, and at least ``least_window``,
    on either side. Null ids, and vectors that are null, zero, not finite or of an unusual length,
    take no part. Equal vectors are one place on the curves that stands for all its ids. Rows with
    the query's own id are the query itself. With k candidates or fewer, all that the windows hold
    are returned. An empty table gives none. Offsets and scales of the curves come from at most
    ``sample_rows`` vectors chosen by hash; every vector is indexed.
    """
    rows = written(usable(vectors, id_col, vector_col).distinct())
    spark = vectors.sparkSession
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; the limit is
    # applied before the shuffle
    order = Window.partitionBy("vec").orderBy("vec_id")
    # vectors themselves are a wide key, but each appears once unless copied
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    points = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("point"), "vec", "ids"
    ))
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array(
        [r[0] for r in points.select("vec", "point").orderBy(F.xxhash64("point"), "point").limit(sample_rows).select("vec").collect()]
    )
    dims = sample.shape[1]
    frames = curve_frames(dims, curves)
    # what all vectors have in common says nothing about distances, but takes digits
    centre = sample.mean(axis=0)
    projected = np.einsum("nd,cdp->cnp", sample - centre, frames)
    middle, spread = projected.mean(axis=1), projected.std(axis=(1, 2)) + 1e-300
    shifts = np.random.default_rng(SEED + 1).uniform(-0.5, 0.5, middle.shape)
    half = 1 << (BITS - 1)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = np.stack(batch["vec"].to_numpy()) - centre if len(batch) else np.zeros((0, dims))
            out = []
            for c in range(curves):
                # 8 spreads to either side; what lies beyond goes to the edge
                at = ((data @ frames[c] - middle[c]) / spread[c] + shifts[c]) / 8
                cells = np.clip(np.floor(at * half) + half, 0, 2 * half - 1).astype(np.int64)
                out.append(pd.DataFrame({"curve": c, "key": hilbert_keys(cells, BITS), "point": batch["point"].to_numpy()}))
            yield pd.concat(out)

    keys = points.select("point", "vec").mapInPandas(places, "curve int, key long, point long")
    # equal keys stand in another order on each curve
    numbered = number_rows(keys, [F.col("curve"), F.col("key"), F.xxhash64("point", "curve"), F.col("point")], "place", 0)
    ranks = numbered.select("point", "curve", (F.col("place") - F.col("curve") * total).alias("at"))
    per_point = ranks.groupBy("point").agg(F.collect_list(F.struct("curve", "at")).alias("places"))
    placed = written(points.join(per_point, "point"))

    reach = max(least_window, int(window * total))
    last_block = (total - 1) // block_rows
    on_curve = placed.select("point", "vec", F.explode("places").alias("p")).select("point", "vec", "p.curve", "p.at")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("vec").alias("query_vec"))
    asked = asked.join(placed.select(F.col("vec").alias("query_vec"), "places"), "query_vec")
    asked = asked.select("query", "query_vec", F.explode("places").alias("p")).select("query", "query_vec", "p.curve", "p.at")
    # a task has one block and one slice of its queries, about block_rows of each
    slices = max(1, -(-int(total * (2 * window) / every) // block_rows))
    blocks = on_curve.select("curve", F.floor(F.col("at") / block_rows).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "point", "vec", "at")
    first = F.greatest(F.lit(0), F.floor((F.col("at") - reach) / block_rows))
    final = F.least(F.lit(last_block), F.floor((F.col("at") + reach) / block_rows))
    wanted = asked.select(
        "curve", F.explode(F.sequence(first, final)).alias("block"), F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int").alias("slice"),
        F.col("query").alias("point"), F.col("query_vec").alias("vec"), "at",
    )
    both = blocks.withColumn("asks", F.lit(False)).unionByName(wanted.withColumn("asks", F.lit(True)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        queries, found = pdf[asks], pdf[~asks]
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(found):
            return empty
        data, at = np.stack(found["vec"].to_numpy()), found["at"].to_numpy()
        names, near = found["point"].to_numpy(), data - centre
        norms = (near * near).sum(axis=1)
        out = []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start : start + 256]
            q = np.stack(part["vec"].to_numpy())
            rough = norms[None, :] - 2 * ((q - centre) @ near.T)
            rough[np.abs(at[None, :] - part["at"].to_numpy()[:, None]) > reach] = np.inf
            keep = min(rough.shape[1], 2 * k + 2)
            best = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(rough, best, axis=1)))
            j = best[i, j]
            exact = np.sqrt(((q[i] - data[j]) ** 2).sum(axis=1))
            out.append(pd.DataFrame({"query": part["point"].to_numpy()[i], "point": names[j], "score": exact}))
        return pd.concat(out) if out else empty

    hits = both.groupBy("curve", "block", "slice").applyInPandas(search, "query long, point long, score double")
    # k + 1 places, as one may be the query's own; the limit is applied before the shuffle too
    hits = hits.groupBy("query", "point").agg(F.min("score").alias("score"))
    nearest_points = Window.partitionBy("query").orderBy("score", "point")
    hits = hits.withColumn("_n", F.row_number().over(nearest_points)).where(F.col("_n") <= k + 1).drop("_n")
    named = hits.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    named = named.where("query <> vec_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
