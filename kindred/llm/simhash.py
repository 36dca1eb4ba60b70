"""SimHash near-duplicates: fingerprints, BK-trees per shard, connected groups.

Two fingerprints that differ in at most r bits agree on at least b - r of b blocks of bits, so
they share one of the C(b, b - r) choices of blocks. Each choice and value of its bits is a
bucket; a shard holds a forest of BK-trees, one tree per bucket, and is searched by following
only edges within the radius. Work is done on distinct fingerprints, so copies cost nothing, and
a shard returns the edges of a spanning forest instead of all pairs: as many rows as it has nodes
at most, while the connected groups stay the same. A bucket over the row limit of a shard is cut
into several trees; every tree is sent to every slice of the bucket's queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from kindred.llm.common import as_bytes, boxed, col, unboxed, written
from kindred.operators.cluster import connected_components

SEED = 42
_AT_ONCE = 65_536  # shingles turned into bits at a time
_QUERIES = 256  # queries that walk a forest together


def fingerprint_of(text: str | None, width: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = as_bytes(text).lower().split()
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    total = max(1, len(words) - width + 1)
    for start in range(0, total, _AT_ONCE):
        part = words[start : start + _AT_ONCE + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(t, width) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return run(text)


def block_plan(count: int, radius: int) -> tuple[int, list[list[int]]]:
    """How many blocks to cut 64 bits into, and the mask of every choice of blocks to agree on.

    More blocks mean longer, rarer keys but more of them; the cheapest number for ``count``
    fingerprints is taken. Every plan finds the same pairs.
    """

    def cost(b: int) -> float:
        keys = comb(b, b - radius)
        return keys * (1 + count / 2 ** (64 * (b - radius) / b) / 64)

    blocks = min(range(radius + 1, radius + 5), key=cost)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return blocks, [sum(parts[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """BK-trees over fingerprints, one for each bucket, in arrays.

    ``child[node, d]`` is the child of ``node`` at Hamming distance d, or -1.
    """

    def __init__(self, values: np.ndarray, buckets: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        roots: dict[int, int] = {}
        rows: dict[tuple[int, int], int] = {}
        whole = values.tolist()
        for node, (value, bucket) in enumerate(zip(whole, buckets.tolist())):
            at = roots.setdefault(bucket, node)
            while at != node:
                d = (whole[at] ^ value).bit_count()
                at = rows.setdefault((at, d), node)
        for (parent, d), node in rows.items():
            self.child[parent, d] = node
        self.roots = roots

    def near(self, queries: np.ndarray, buckets: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, some queries at a time."""
        roots = np.array([self.roots.get(b, -1) for b in buckets.tolist()], np.int32)
        for start in range(0, len(queries), _QUERIES):
            at = roots[start : start + _QUERIES]
            q = np.flatnonzero(at >= 0)
            node, q = at[q], q + start
            found_q, found_n = [], []
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                found_q.append(q[hit])
                found_n.append(node[hit])
                next_q, next_n = [], []
                for step in range(-radius, radius + 1):
                    edge = d + step
                    inside = (edge >= 1) & (edge <= 64)
                    kids = self.child[node[inside], edge[inside]]
                    real = kids >= 0
                    next_q.append(q[inside][real])
                    next_n.append(kids[real])
                q, node = np.concatenate(next_q), np.concatenate(next_n)
            if found_q:
                yield np.concatenate(found_q), np.concatenate(found_n)


def spanning(values: np.ndarray, buckets: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int):
    """Edges (as index pairs into ``values``) of a spanning forest of all links between the nodes
    marked as tree and those marked as query, within each bucket."""
    label = np.arange(len(values))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    trees, asks = np.flatnonzero(is_tree), np.flatnonzero(is_query)
    forest = Forest(values[trees], buckets[trees])
    for q, n in forest.near(values[asks], buckets[asks], radius):
        a, b = asks[q], trees[n]
        while not np.array_equal(label, label[label]):
            label = label[label]
        la, lb = label[a], label[b]
        apart = la != lb
        if apart.any():
            pairs = np.unique(np.stack([np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]]), axis=1)
            for x, y in pairs.T.tolist():
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)
    while not np.array_equal(label, label[label]):
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return moved, label[moved]


def fingerprint_links(nodes: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """``nodes``: distinct fingerprints in column ``fp``. Returns src, dst: links that connect
    exactly the groups which all links within ``radius`` connect.

    ``shard_rows`` is about the number of fingerprints in a shard; a task sees at most twice as
    many at a time (a tree slice and a query slice of a larger bucket).
    """
    count = nodes.count()
    if count < 2:
        return nodes.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where("false")
    _, masks = block_plan(count, radius)
    keyed = nodes.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("pick", "bits"),
    )
    sizes = keyed.groupBy("pick", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / shard_rows).cast("int")
    shards = max(1, -(-count // (shard_rows // 2)))
    placed = keyed.join(sizes, ["pick", "bits"]).withColumn("slices", slices).withColumn(
        "slice", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("slices")).cast("int")
    )
    # a bucket of one slice meets itself; of several, slice i is the tree for queries of slice j <= i
    own = F.col("slice")
    tiles = F.when(F.col("slices") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.array_distinct(F.concat(
            F.transform(F.sequence(F.lit(0), own), lambda j: F.struct(own.alias("i"), j.alias("j"))),
            F.transform(F.sequence(own, F.col("slices") - 1), lambda i: F.struct(i.alias("i"), own.alias("j"))),
        ))
    )
    shard = F.when(F.col("slices") == 1, F.pmod(F.xxhash64("bits", F.lit(2)), F.lit(shards))).otherwise(F.col("bits"))
    tiled = placed.select(
        "fp", "pick", "bits", "slice", (F.col("slices") > 1).alias("hot"), shard.alias("shard"), F.explode(tiles).alias("t")
    ).select("fp", "pick", "bits", "slice", "hot", "shard", "t.i", "t.j")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        hot = pdf["hot"].to_numpy()
        mine = pdf["slice"].to_numpy()
        tree = ~hot | (mine == pdf["i"].to_numpy())
        asks = ~hot | (mine == pdf["j"].to_numpy())
        a, b = spanning(values, pdf["bits"].to_numpy(), tree, asks, radius)
        signed = values.view(np.int64)
        return pd.DataFrame({"src": signed[a], "dst": signed[b]})

    found = tiled.groupBy("pick", "hot", "shard", "i", "j").applyInPandas(work, "src long, dst long")
    return found.distinct()


def simhash_groups(
    docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text",
    shard_rows: int = 4096,
) -> DataFrame:
    """Near-duplicate groups of documents by SimHash.

    Words are runs of non-white-space with A-Z lower-cased; shingles have ``width`` words, repeats
    count; a text of fewer words is one shingle. Returns one row per row of ``docs``: doc_id,
    fp (signed 64-bit fingerprint), component (a fingerprint that names the group), component_id
    (smallest doc_id of the group).

    Null and empty texts have the fingerprint 0 and link like any other. A null doc_id never is
    the smallest unless its group has no other. Repeated rows stay. An empty table gives none.
    Other columns are not read.
    """
    prints = written(docs.select(col(id_col).alias("doc_id"), fingerprint_column(col(text_col), width).alias("fp")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(nodes.select("fp"), radius, shard_rows)
    reached = connected_components(links)
    named = nodes.join(reached, nodes["fp"] == reached["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = written(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = named.join(least, "component").select("fp", "component", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component", "component_id")


def drop_near_copies(
    docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group stays: the one with the smallest id. All columns are kept.

    Of repeated rows with that id one stays. A group without any id keeps one row.
    """
    groups = written(simhash_groups(docs, radius, width, id_col, text_col))
    # several rows with the id of a head have to be told apart
    heads = groups.groupBy(F.col("doc_id").alias("head")).agg(
        F.max(F.expr("doc_id <=> component_id")).alias("leads"), (F.count(F.lit(1)) > 1).alias("several")
    ).where("leads")
    rows = boxed(docs, id=col(id_col)).join(heads, F.col("id").eqNullSafe(F.col("head")))
    once = rows.where("not several")
    if not heads.where("several").head(1):
        return unboxed(once, docs.columns)
    lead = groups.where("doc_id <=> component_id").select("fp", "component", "doc_id").distinct()
    twice = rows.where("several").withColumn("print", fingerprint_column(F.col("row").getField(text_col), width))
    twice = twice.join(lead, (F.col("print") == F.col("fp")) & F.col("id").eqNullSafe(F.col("doc_id")))
    twice = twice.dropDuplicates(["component"]).select("row")
    return unboxed(once.select("row").unionByName(twice), docs.columns)
