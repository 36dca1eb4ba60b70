"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.plans.cut import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # the per-node minimum is pre-aggregated; joining it back meets a unique key on one side, so
    # a node with very many edges is split by AQE like any skewed join
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("root"))
    return (
        both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("root"))
    near = down.join(least, "src").where("dst <> root").select(
        F.col("dst").alias("src"), F.col("root").alias("dst")
    )
    return near.unionAll(least.withColumnRenamed("root", "dst")).distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``edges``: src, dst of integer ids. Returns node, component (the smallest id in it).

    ``vertices`` (column node) adds those without edges, each a component of its own; without it
    only nodes with edges appear.
    """
    current = cut_lineage(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        current = cut_lineage(_small_star(_large_star(current)))
    roots = current.select(F.col("dst").alias("node")).distinct()
    found = current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
    if vertices is None:
        return found
    alone = vertices.select("node").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))
