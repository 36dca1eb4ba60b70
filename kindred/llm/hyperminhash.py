"""Near duplicates by HyperMinHash: compressed registers, bands, estimates, checks on whole sets.

A document is its set of word shingles, each a 64-bit hash. The upper bits of a hash say which of
256 buckets it falls in; of the smallest rest in a bucket the register keeps the number of leading
zeros and ten mantissa bits, 16 bits in all. Buckets without a hash take a filled one over, each in an
order of its own, so that small sets agree in about as many registers as they have in common.

Documents whose registers agree in a whole band are candidates. How many registers two candidates
share, less those that agree by chance, estimates their similarity; pairs far below the limit go, and
the others are compared on their whole sets.

No band lists its pairs. Equal sets are one node to begin with; in every band the member with most
band mates, usually the text the others were made from, is compared with the rest; nodes that turn
out to be linked are one component, and bands that hold a single component are done. The rest is sorted out
inside tasks, in tiles of bounded size: members of different components are estimated, then counted on
their whole sets, and a tile returns a spanning forest of the links it finds, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from kindred.llm.common import as_bytes, boxed, col, written
from kindred.operators.cluster import connected_components

SEED = 12
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BANDS = 32
BAND_WIDTH = 4
# an estimate may lie so many standard deviations under the limit before a pair goes unchecked
DEVIATIONS = 6
# rows of the bitmap that says which texts to read again; 64 bits each, so a broadcast of 1 MB
BITMAP_ROWS = 65_536
_AT_ONCE = 65_536
# from a band register without a hash, the order in which it looks for a filled one; itself first
_ORDER = np.stack([
    np.concatenate([[j], (lambda p: p[p != j])(np.random.default_rng([SEED, j]).permutation(BUCKETS))])
    for j in range(BANDS * BAND_WIDTH)
])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle as a whole."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = []
    for start in range(0, len(words) - width + 1, _AT_ONCE):
        part = words[start : start + _AT_ONCE + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width))))
        parts.append(np.unique(np.fromiter(map(xxh3_64_intdigest, joined, repeat(SEED)), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit register per bucket from sorted hashes: leading zeros plus one, then the mantissa; 0 if empty."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so the smallest rest of its bucket
    # the 52 upper bits of the rest, exact in a double
    rest = (hashes[first] >> np.uint64(64 - BUCKET_BITS - 52)) & np.uint64((1 << 52) - 1)
    mantissa, exponent = np.frexp(rest.astype(float))
    kept = np.floor((2 * mantissa - 1) * (1 << MANTISSA)) * (rest > 0)
    out[bucket[first]] = ((53 - exponent) << MANTISSA) + kept.astype(np.int64)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of every row of registers; rows must not be empty."""
    out = []
    for start in range(0, len(registers), 256):
        part = registers[start : start + 256]
        source = np.take((part > 0), _ORDER, axis=1).argmax(axis=2)
        source = _ORDER[np.arange(len(_ORDER)), source]
        # where a register was taken from tells more than its 16 bits
        value = (source.astype(np.uint64) << np.uint64(16)) | np.take_along_axis(part, source, axis=1).astype(np.uint64)
        value = value.reshape(len(part), BANDS, BAND_WIDTH)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(BAND_WIDTH):
            key = (key ^ value[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out).view(np.int64)


def chance_agreement(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Share of registers that agree between sets of these sizes without a common element.

    With x and y hashes in a bucket on average, both smallest rests fall into the same cell of width w
    at t with probability about x y w^2 e^(-(x + y) t), summed over the cells of every leading-zero count.
    """
    x, y = size_a / BUCKETS, size_b / BUCKETS
    total = x + y
    out = np.zeros(len(x))
    for zeros in range(53):
        high = 2.0**-zeros
        out += high / 2 / (1 << MANTISSA) * (np.exp(-total * high / 2) - np.exp(-total * high))
    return out * x * y / total


def estimated_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of register rows, and the number of buckets it rests on."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    both = ((a > 0) & (b > 0)).sum(axis=1)
    # only registers that don't agree anyway can agree by chance
    by_chance = chance_agreement(size_a, size_b) * (both - equal)
    return (equal - by_chance) / np.maximum(filled, 1), filled


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate of each pair is not too far below the limit.

    The buckets are a sample of the union without replacement: the more of the union they show, the
    less the estimate strays.
    """
    found, filled = estimated_similarity(a, b, size_a.astype(float), size_b.astype(float))
    limit = percent / 100
    union = np.maximum((size_a + size_b) / (1 + limit), filled + 1)
    variance = limit * (1 - limit) / np.maximum(filled, 1) * (1 - filled / union)
    # two buckets more for small sets, whose hashes may share one
    return found >= limit - DEVIATIONS * np.sqrt(variance) - 2 / np.maximum(filled, 1)


def _prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's own hashes t1 and t2, and key, n, registers of its set."""

    @F.pandas_udf("key binary, n long, registers binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, sizes, registers = [], [], []
            for text in texts:
                hashes = shingle_set(text, width)
                keys.append(xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                registers.append(registers_of(hashes).tobytes())
            yield pd.DataFrame({"key": keys, "n": sizes, "registers": registers})

    rows = boxed(docs, doc_id=col(id_col), text=col(text_col))
    return rows.select("doc_id", *_text_hashes(), sketch("text").alias("s")).select("doc_id", "t1", "t2", "s.*")


def _text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _bands(nodes: DataFrame) -> DataFrame:
    """band, node: a row for every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                keys = band_keys(registers)
                each = np.repeat(batch.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(each)], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, node long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """node, hashes of the ``wanted`` nodes (node, key, t1, t2), from one text of each.

    A bitmap of fixed size keeps most other texts out of the shuffle; those it lets through by chance
    find no partner.
    """
    row, bit = F.pmod("t1", F.lit(BITMAP_ROWS)).cast("int"), F.pmod(F.shiftright("t1", 32), F.lit(64)).cast("int")
    single = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = wanted.groupBy(row.alias("row")).agg(F.bit_or(single).alias("bits"))
    texts = docs.select(col(text_col).alias("text")).where("text is not null").select("text", *_text_hashes()).withColumn("row", row)
    texts = texts.join(F.broadcast(bitmap), "row").where(F.col("bits").bitwiseAND(single) != 0)
    # copies of a text are merged in the tasks already
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in part], dtype=object)

    return texts.join(wanted.select("node", "t1", "t2"), ["t1", "t2"]).select("node", hashes("text").alias("hashes"))


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow, and whose registers suggest, enough similarity."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ra, rb, na, nb in batches:
            a, b = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, BUCKETS) for r in (ra, rb))
            yield pd.Series(_may_link(a, b, na.to_numpy(), nb.to_numpy(), percent))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("registers").alias(f"r{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.where(near("ra", "rb", "na", "nb")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst of the pairs whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    union = F.size("ha") + F.size("hb") - common
    return both.where(common * 100 >= union * percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _promising_in_tile(registers: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether row left[i] and row right[j] may be similar enough, by size and estimate."""
    out = np.zeros((len(left), len(right)), bool)
    step = max(1, 2_000_000 // (len(right) * BUCKETS))
    for start in range(0, len(left), step):
        rows = left[start : start + step]
        na, nb = sizes[rows][:, None], sizes[right][None, :]
        i, j = np.nonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
        if len(i):
            out[start + i, j] = _may_link(registers[rows[i]], registers[right[j]], sizes[rows[i]], sizes[right[j]], percent)
    return out


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left[i] and right[j], by products of 0-1 matrices."""
    used = np.unique(np.concatenate([left, right]))
    values, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    several = np.bincount(column, minlength=len(values)) > 1  # what only one set holds is in no intersection
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    at_l, at_r = np.searchsorted(used, left), np.searchsorted(used, right)
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2^24 per product; sums below are whole numbers
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(several.sum()), 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        dense = np.zeros((len(used), 2048), np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        np.matmul(dense[at_l], dense[at_r].T, out=out)
        total += out.astype(np.int64)
    return total


def spanning_links(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (indexes into ``sets``) between members of left and right that join all components which
    similar sets connect."""
    sizes = np.array([len(s) for s in sets])
    registers = np.stack([registers_of(s) for s in sets])
    near = _promising_in_tile(registers, sizes, left, right, percent)
    near &= component[left][:, None] != component[right][None, :]
    rows, columns = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return []
    left, right, near = left[rows], right[columns], near[np.ix_(rows, columns)]
    common = _common(sets, left, right)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero(near & (common * 100 >= union * percent))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, b in zip(left[i].tolist(), right[j].tolist()):
        one, other = find(int(component[a])), find(int(component[b]))
        if one != other:
            root[one] = other
            out.append((a, b))
    return out


def _links_in_tiles(rows: DataFrame, sets: DataFrame, percent: int, tile_rows: int, tile_hashes: int) -> DataFrame:
    """src, dst: links that connect what similar sets of one band connect. ``rows``: band, node, component.

    Small bands share a task; a band of more than ``tile_rows`` rows or ``tile_hashes`` hashes is cut into
    slices, and every two slices meet in a task of their own.
    """
    sized = rows.join(sets.select("node", F.size("hashes").alias("n")), "node")
    sizes = written(sized.groupBy("band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / tile_rows), F.ceil(F.sum("n") / tile_hashes)).cast("int").alias("slices"),
        F.sum("n").alias("held"), F.count(F.lit(1)).alias("members"),
    ))
    held = sizes.agg(F.sum("held"), F.sum("members")).first()
    shards = max(1, -(-int(held[0] or 0) // tile_hashes), -(-int(held[1] or 0) // tile_rows))
    hot = F.col("slices") > 1
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("slices")).cast("int")
    placed = rows.join(sizes.select("band", "slices"), "band").withColumn("slice", own)
    tiles = F.array_distinct(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("slice")), lambda j: F.struct(F.col("slice").alias("i"), j.alias("j"))),
        F.transform(F.sequence(F.col("slice"), F.col("slices") - 1), lambda i: F.struct(i.alias("i"), F.col("slice").alias("j"))),
    ))
    shard = F.when(hot, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(shards)))
    tiled = placed.select("node", "component", "band", "slice", hot.alias("hot"), shard.alias("shard"), F.explode(tiles).alias("t"))
    tiled = tiled.select("node", "component", "band", "slice", "hot", "shard", "t.i", "t.j").join(sets, "node")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        node, component, band = (part[c].to_numpy(np.int64) for c in ("node", "component", "band"))
        where, i, j = (part[c].to_numpy(np.int64) for c in ("slice", "i", "j"))
        order = np.argsort(band, kind="stable")
        found = []
        for members in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            sets = [np.asarray(part["hashes"].iloc[m], np.int64).view(np.uint64) for m in members.tolist()]
            everyone = np.arange(len(members))
            left, right = everyone[where[members] == i[members]], everyone[where[members] == j[members]]
            found += [(node[members[a]], node[members[b]]) for a, b in spanning_links(sets, component[members], left, right, percent)]
        return pd.DataFrame(found, columns=["src", "dst"], dtype=np.int64)

    return tiled.groupBy("hot", "shard", "i", "j").applyInPandas(work, "src long, dst long").distinct()


def _pair(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def similar_sets(docs: DataFrame, nodes: DataFrame, percent: int, width: int, text_col: str, tile_rows: int = 1000,
                 tile_hashes: int = 1_000_000) -> DataFrame:
    """node, component of all nodes that are linked to another one. ``nodes`` is a written table of
    distinct sets: node, n, registers, t1, t2."""
    # of two different sets with p % in common the smaller has at least p / (100 - p) elements
    able = nodes.where(F.col("n") * (100 - percent) >= percent)
    banded = written(_bands(able))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(banded.join(sizes, "band"))
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    rows = written(shared.join(degrees, "node").select("band", "node", "degree"))
    wanted = degrees.select("node").join(nodes.select("node", "t1", "t2"), "node")
    sets = written(_sets(docs, wanted, width, text_col))

    # every member of a band meets its head
    heads = rows.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("head"))
    headed = rows.join(heads, "band").where(F.col("node") != F.col("head.node"))
    met = written(headed.select(*_pair(F.col("node"), F.col("head.node"))).distinct())
    links = written(_linked(_promising(met, nodes, percent), sets, percent))
    component = connected_components(links)

    # the others of a band go on where they are still apart
    rest = headed.select("band", "node").join(component, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component")
    )
    apart = rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = written(rest.join(apart.select("band"), "band"))
    more = written(_links_in_tiles(rest, sets, percent, tile_rows, tile_hashes))
    return connected_components(links.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    tile_rows: int = 1000, tile_hashes: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are runs of non-white-space with A-Z lower-cased. A document is the set of its distinct shingles
    of ``width`` words; with fewer words, all of them as one shingle. Documents with at least ``percent`` %
    of their united shingles in common are linked; component_id is the smallest doc_id that links reach.
    kept says whether that is the row's own.

    Bands miss a pair at the very limit of 80 % with a probability of about 5 in 10^8, and a pair above it
    with less; no link is made that the whole sets don't confirm. Null texts and texts without words are
    linked with nothing. A null doc_id is never the smallest unless its component has no other; such
    rows are kept then. ``tile_rows`` and ``tile_hashes`` bound what a task holds and change no result. Repeated
    rows stay, with equal results. An empty table gives none. Other columns
    are not read.
    """
    prints = written(_prints(docs, width, id_col, text_col))
    sets = prints.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"),
        F.min(F.struct("t1", "t2")).alias("t"),
    )
    nodes = written(sets.select("key", "least", "n", "registers", "t.t1", "t.t2", F.monotonically_increasing_id().alias("node")))
    reached = similar_sets(docs, nodes, percent, width, text_col, tile_rows, tile_hashes)
    named = written(nodes.select("node", "key", "least").join(reached, "node", "left").select(
        "key", "least", F.coalesce("component", "node").alias("component")
    ))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = named.join(least, "component").select("key", "component_id")
    rows = prints.select("doc_id", F.col("n").alias("n_shingles"), "key").join(members, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
