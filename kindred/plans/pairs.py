"""Pairs of rows with an equal key, and how many of them to expect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kindred.plans.cut import cut_lineage

# Rows of one key that meet in one tile on each side; a tile makes a few million pairs at most. The
# bytes of a hot key are often too few for AQE to see the skew, but its pairs are not. Copying the
# rows along the grid costs one row per TILE_ROWS / 2 pairs.
TILE_ROWS = 2_000

# Ids of one left list in ``join_lists``: a task holds the pairs of one list with one tile at a time.
LIST_ROWS = 4


def spread(df: DataFrame, *by: str, waves: int = 3) -> DataFrame:
    """Partition by ``by`` for a step that costs far more time than bytes.

    AQE merges small shuffle partitions by their size, which would put such a step into a few
    tasks; a partition number given here is left alone.
    """
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # not the usual number itself: a shuffle like the one below would be dropped as redundant
    return df.repartition(max(usual, waves * spark.sparkContext.defaultParallelism) + 1, *by)


def pair_forecast(df: DataFrame, block: str) -> DataFrame:
    """Rows and pairs per block, before any pair is made: look here first on a large table."""
    n = F.col("n_rows").cast("decimal(19,0)")
    return (
        df.where(F.col(block).isNotNull())
        .groupBy(block)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_pairs", ((n * (n - 1)) / 2).cast("decimal(38,0)"))
    )


def largest_groups(df: DataFrame, keys: list[str]) -> list[int]:
    """Rows of the most frequent value of each key column, all keys in one job."""
    tops = [
        df.where(F.col(k).isNotNull()).groupBy(k).count()
        .agg(F.lit(i).alias("at"), F.coalesce(F.max("count"), F.lit(0)).alias("n"))
        for i, k in enumerate(keys)
    ]
    return [r["n"] for r in sorted(reduce(DataFrame.unionAll, tops).collect())]


def hot_keys(df: DataFrame, on: list[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Keys with more rows than one tile; at most rows/tile_rows of them."""
    return (
        df.dropna(subset=on)
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > tile_rows)
        .select(*on, F.ceil(F.col("_n") / tile_rows).alias("_tiles"))
    )


def _turned(left: DataFrame, right: DataFrame, on: list[str], id_l: str, id_r: str) -> list[Column]:
    """Columns of both sides, which are the same rows, with the smaller id on the left."""
    oriented = F.col(id_l) < F.col(id_r)
    turned = {}
    for a, b in zip([c for c in left.columns if c not in on], [c for c in right.columns if c not in on]):
        turned[a] = F.when(oriented, F.col(a)).otherwise(F.col(b))
        turned[b] = F.when(oriented, F.col(b)).otherwise(F.col(a))
    return [c.alias(name) for name, c in turned.items()]


def join_pairs(
    left: DataFrame, right: DataFrame, on: list[str], id_l: str, id_r: str,
    same: bool = False, tile_rows: int | None = TILE_ROWS, hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of two sides whose other columns differ in name.

    A key that holds a large share of the rows would put all its pairs into one task. Such keys
    are cut into a grid: each left row falls into one grid row and is copied along it, each right
    row into one grid column, so every pair meets in exactly one tile of bounded size. The other
    keys form a grid of one tile. ``tile_rows`` None says that no key is known to be large. ``hot``: the
    keys to cut, with ``_tiles_l`` and ``_tiles_r``, where the caller knows them without counting.

    ``same`` says that both sides are the same rows, with their columns in the same order: each
    pair comes once, the smaller id on the left. Of the grid only the half on one side of the
    diagonal is made, and pairs that meet there the wrong way round are turned.
    """
    if same:
        oriented = F.col(id_l) < F.col(id_r)
        if tile_rows is None:
            return spread(left, *on).join(right, on).where(oriented)
        hot = cut_lineage(hot_keys(left, on, tile_rows))
        if hot.isEmpty():
            return spread(left, *on).join(right, on).where(oriented)
        tiles = F.coalesce("_tiles", F.lit(1).cast("bigint"))

        def on_half(side, row_id, first, last, own_name, other_name):
            own = F.pmod(F.xxhash64(row_id), tiles)
            placed = side.join(hot, on, "left").withColumn(own_name, own)
            bounds = F.sequence(first(F.col(own_name)), last(F.col(own_name)))
            return placed.withColumn(other_name, F.explode(bounds)).drop("_tiles")

        zero = F.lit(0).cast("bigint")
        half_l = on_half(left, id_l, lambda t: t, lambda t: tiles - 1, "_tile_l", "_tile_r")
        half_r = on_half(right, id_r, lambda t: zero, lambda t: t, "_tile_r", "_tile_l")
        tile = [*on, "_tile_l", "_tile_r"]
        met = spread(half_l, *tile).join(half_r, tile).where(
            (F.col("_tile_l") < F.col("_tile_r")) | oriented
        )
        return met.select(*on, *_turned(left, right, on, id_l, id_r))
    if tile_rows is None:
        return spread(left, *on).join(right, on)
    if hot is None:
        hot = hot_keys(left, on, tile_rows).withColumnRenamed("_tiles", "_tiles_l")
        hot_r = hot_keys(right, on, tile_rows).withColumnRenamed("_tiles", "_tiles_r")
        hot = cut_lineage(hot.join(hot_r, on, "full_outer"))
    if hot.isEmpty():
        return spread(left, *on).join(right, on)
    tiles_l = F.coalesce("_tiles_l", F.lit(1))
    tiles_r = F.coalesce("_tiles_r", F.lit(1))

    def on_grid(side, row_id, own, other, own_name, other_name):
        return (
            side.join(hot, on, "left")
            .withColumn(own_name, F.pmod(F.xxhash64(row_id), own))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)))
            .drop("_tiles_l", "_tiles_r")
        )

    grid_l = on_grid(left, id_l, tiles_l, tiles_r, "_tile_l", "_tile_r")
    grid_r = on_grid(right, id_r, tiles_r, tiles_l, "_tile_r", "_tile_l")
    tile = [*on, "_tile_l", "_tile_r"]
    return spread(grid_l, *tile).join(grid_r, tile).drop("_tile_l", "_tile_r")


def alike(df: DataFrame, row_id: str) -> float:
    """Rows per distinct combination of the columns other than the id, on average; 0 without rows."""
    others = [c for c in df.columns if c != row_id]
    sizes = df.groupBy(*others).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]


def join_lists(
    left: DataFrame, right: DataFrame, on: list[str], id_l: str, id_r: str,
    same: bool = False, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``join_pairs`` for sides with many rows that are alike in all columns but the id, and ids without nulls.

    Rows that are alike stand in lists of ids: a list is shuffled and joined once for all its ids, and only
    then are the pairs written out. The grid of large keys is that of ``join_pairs``.
    """
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    hot = hot_keys(left, on, tile_rows).withColumnRenamed("_tiles", "_tiles_l")
    hot_r = hot.withColumnRenamed("_tiles_l", "_tiles_r")
    if not same:
        hot_r = hot_keys(right, on, tile_rows).withColumnRenamed("_tiles", "_tiles_r")
    hot = cut_lineage(hot.join(hot_r, on, "full_outer"))
    zero, one = (F.lit(n).cast("bigint") for n in (0, 1))
    tiles_l, tiles_r = F.coalesce("_tiles_l", one), F.coalesce("_tiles_r", one)

    def listed(side: DataFrame, row_id: str, tiles, own: str) -> DataFrame:
        placed = side.join(hot, on, "left").withColumn(own, F.pmod(F.xxhash64(row_id), tiles))
        return placed.groupBy(*(c for c in placed.columns if c != row_id)).agg(F.collect_list(row_id).alias(row_id))

    def laid(lists: DataFrame, other: str, first, last) -> DataFrame:
        return lists.withColumn(other, F.explode(F.sequence(first, last))).drop("_tiles_l", "_tiles_r")

    starts = F.sequence(F.lit(1), F.size(id_l), F.lit(LIST_ROWS))
    lists_l = listed(left, id_l, tiles_l, "_tile_l").withColumn(
        id_l, F.explode(F.transform(starts, lambda at: F.slice(id_l, at, LIST_ROWS)))
    )
    lists_r = listed(right, id_r, tiles_r, "_tile_r")
    # of one table only the half on one side of the diagonal
    grid_l = laid(lists_l, "_tile_r", F.col("_tile_l") if same else zero, tiles_r - 1)
    grid_r = laid(lists_r, "_tile_l", zero, F.col("_tile_r") if same else tiles_l - 1)
    tile = [*on, "_tile_l", "_tile_r"]
    # hardly any bytes but all the pairs: many small tasks, so that none ends long after the others
    met = spread(grid_l, *tile, waves=10).join(grid_r, tile)
    met = met.withColumn(id_l, F.explode(id_l)).withColumn(id_r, F.explode(id_r))
    if not same:
        return met.select(*columns)
    met = met.where((F.col("_tile_l") < F.col("_tile_r")) | (F.col(id_l) < F.col(id_r)))
    return met.select(*on, *_turned(left, right, on, id_l, id_r))
