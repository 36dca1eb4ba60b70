"""Large groups of records that share a key, compared tile by tile.

A join hands every pair of a group over as a row of its own, with all compared values, and text
comparisons pay for each. Here the rows of a large group are cut into a grid: every tile is one task that holds
up to GRID_ROWS records of each side (GRID_WIDE of a second table), compares one record with all of the other side at once
(``functions.levels``), and returns what is asked for: all pairs with their levels, those that can reach a
threshold, or how many pairs agree in which way.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.config import LinkConfig
from kindred.functions.compare import SLOW_TYPES, top_level
from kindred.functions.levels import GRID_TYPES, LevelRows, codes
from kindred.plans.cut import cut_lineage
from kindred.plans.pairs import spread

GRID_ROWS = 2_000
GRID_WIDE = 16_000   # rows of the second of two tables, which one record meets at once
GRID_PAIRS = 10_000  # pairs from which a group is worth a task of its own
_FLUSH = 200_000     # pairs in a batch that leaves a task


def suits_grid(config: LinkConfig) -> bool:
    """Whether there is text to compare, and all of it has a kernel. Equality alone is left to joins."""
    kinds = config.comparisons.values()
    return all(kind in GRID_TYPES for kind in kinds) and any(kind != "exact" for kind in kinds)


def large_groups(left: DataFrame, right: DataFrame | None, on: list[str], names: list[str]) -> DataFrame:
    """``names`` (the key, from columns ``on``), _tiles_l, _tiles_r of the keys with very many pairs. Written."""
    def sizes(side: DataFrame, s: str) -> DataFrame:
        keyed = side.select(*(F.col(c).alias(n) for c, n in zip(on, names))).dropna()
        return keyed.groupBy(*names).agg(F.count(F.lit(1)).alias(f"_n_{s}"))

    n = sizes(left, "l")
    both = n.withColumn("_n_r", F.col("_n_l")) if right is None else n.join(sizes(right, "r"), names)
    many = both.where(F.col("_n_l") * F.col("_n_r") >= GRID_PAIRS)
    rows = {"l": GRID_ROWS, "r": GRID_ROWS if right is None else GRID_WIDE}
    return cut_lineage(many.select(
        *names, *(F.ceil(F.col(f"_n_{s}") / rows[s]).cast("bigint").alias(f"_tiles_{s}") for s in "lr")
    ))


def _tiles(left: DataFrame, right: DataFrame | None, on: list[str], large: DataFrame, names: list[str]) -> DataFrame:
    """The rows of both sides in large groups, once per tile: names, _tile_l, _tile_r, _side and their columns."""
    def placed(side: DataFrame, own: str) -> DataFrame:
        keyed = side.withColumns({n: F.col(c) for c, n in zip(on, names)}).join(large, names)
        return keyed.withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own)))

    zero = F.lit(0).cast("bigint")

    def laid(side: DataFrame, place: int, tile_l: Column, tile_r: Column) -> DataFrame:
        columns = [c for c in side.columns if c not in ("_own", "_tiles_l", "_tiles_r")]
        return side.select(*columns, F.lit(place).alias("_side"), tile_l.alias("_tile_l"), tile_r.alias("_tile_r"))

    own = F.col("_own")
    one = placed(left, "_tiles_l")
    if right is None:
        # half of the grid; on its diagonal the rows meet one another
        rows = laid(one, 0, own, F.explode(F.sequence(own, F.col("_tiles_l") - 1)))
        others = laid(one.where("_own > 0"), 1, F.explode(F.sequence(zero, own - 1)), own)
    else:
        rows = laid(one, 0, own, F.explode(F.sequence(zero, F.col("_tiles_r") - 1)))
        others = laid(placed(right, "_tiles_r"), 1, F.explode(F.sequence(zero, F.col("_tiles_l") - 1)), own)
    return rows.unionByName(others)


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, list], dict[str, list]]:
    """Columns of the tile's two sides, in the order of their ids."""
    table = pa.Table.from_batches(list(batches)).sort_by("id")
    side = table["_side"].to_numpy()
    return tuple({c: part[c].to_pylist() for c in part.column_names} for part in (table.filter(pa.array(side == s)) for s in (0, 1)))


def _meetings(first: dict, second: dict, same: bool) -> list[tuple[dict, dict]]:
    """Which side's records stand on the left of a pair: within one table those with the smaller id."""
    if same and first["id"] and first["_tile_l"][0] == first["_tile_r"][0]:
        return [(first, first)]
    if not first["id"] or not second["id"]:  # no row of the group fell into this slice
        return []
    return [(first, second), (second, first)] if same else [(first, second)]


def _starts(left: dict, right: dict, same: bool) -> np.ndarray:
    if not same:
        return np.zeros(len(left["id"]), np.int64)
    return np.searchsorted(np.array(right["id"], np.int64), np.array(left["id"], np.int64), side="right")


def grid_pairs(
    left: DataFrame, right: DataFrame | None, keys: list[str], large: DataFrame, names: list[str], config: LinkConfig,
    rule: int, made: list[list[str]], model=None, need: float = 0.0,
) -> DataFrame:
    """Pairs of the large groups as ``with_levels`` gives them, but for those equal on a rule before ``rule`` or on
    all columns of a set in ``made``. With a model, only those that can have the weight ``need``."""
    kinds, same = list(config.comparisons.values()), right is None
    n_rules = len(config.blocking_columns)
    prior = model.prior_weight if model is not None else 0.0
    # weights by level, from -1 (missing) on; a slow type counts with its best level short of equal at first
    weights = [np.array([0.0, *model.weights(c)]) for c in config.columns] if model is not None else None
    hopes = [np.where(np.arange(len(w)) < len(w) - 1, max(0.0, *w[1:-1]), w) for w in weights] if model is not None else None
    types = {f.name: f.dataType for f in left.schema.fields}
    schema = StructType().add("id_l", types["id"]).add("id_r", types["id"])
    schema = schema.add("copies_l", types["copies"]).add("copies_r", types["copies"])
    for name in ("match_key", "agree", *(f"gamma_{i}" for i in range(len(kinds)))):
        schema = schema.add(name, "integer")
    arrow = to_arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _read(batches)
        for a, b in _meetings(*sides, same):
            rows = [LevelRows(kind, a[f"v{i}"], b[f"v{i}"]) for i, kind in enumerate(kinds)]
            key_codes = [codes(a[f"k{j}"], b[f"k{j}"]) for j in range(n_rules)]
            ids_a, ids_b = (np.array(s["id"], np.int64) for s in (a, b))
            copies_a, copies_b = (np.array(s["copies"], np.int64) for s in (a, b))
            starts, size = _starts(a, b, same), len(ids_b)
            found: list[tuple] = []
            waiting = 0

            def batch() -> pa.RecordBatch:
                at_l = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
                at_r, agree = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                gammas = []
                for k, row in enumerate(rows):
                    late = model is not None and row.kind in SLOW_TYPES
                    gammas.append(row.of_pairs(at_l, at_r) if late else np.concatenate([f[3][k] for f in found]))
                data = [ids_a[at_l], ids_b[at_r], copies_a[at_l], copies_b[at_r], np.full(len(at_l), rule), agree, *gammas]
                return pa.RecordBatch.from_arrays([pa.array(d).cast(f.type) for d, f in zip(data, arrow)], schema=arrow)

            for i, start in enumerate(starts.tolist()):
                if start >= size:
                    continue
                agree = np.zeros(size - start, np.int32)
                for j, (own, other) in enumerate(key_codes):
                    if own[i] >= 0:
                        agree |= (other[start:] == own[i]).astype(np.int32) << j
                keep = (agree & ((1 << rule) - 1)) == 0
                for columns in made:
                    keep &= ~reduce(np.logical_and, [rows[int(c[1:])].equal(i, start) for c in columns])
                levels: list = [None] * len(rows)
                if model is not None:
                    reach = np.full(size - start, prior)
                    for k, row in enumerate(rows):
                        if row.kind in SLOW_TYPES:
                            if row.code_l[i] >= 0:
                                hope = np.where(row.equal(i, start), hopes[k][-1], hopes[k][1])
                                hope[row.unknown[start:]] = 0.0
                                reach += hope
                        else:
                            levels[k] = row.row(i, start)
                            reach += weights[k][levels[k] + 1]
                    keep &= reach >= need
                else:
                    levels = [row.row(i, start) for row in rows]
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                found.append((i, at + start, agree[at], [None if g is None else g[at] for g in levels]))
                waiting += len(at)
                if waiting >= _FLUSH:
                    yield batch()
                    found, waiting = [], 0
            if found:
                yield batch()

    compared = {c for c in left.columns if c[0] in "vk" and c[1:].isdigit()} | {"id", "copies"}
    needed = [c for c in left.columns if c in compared]
    tiles = _tiles(left.select(needed), None if same else right.select(needed), keys, large, names)
    tile = [*names, "_tile_l", "_tile_r"]
    return spread(tiles, *tile).groupBy(*tile).applyInArrow(compare, schema)


def grid_counts(
    left: DataFrame, right: DataFrame | None, large: DataFrame, config: LinkConfig, keyed: dict[int, int],
) -> DataFrame:
    """Pairs of weighted tuples (see ``hot._tuples``) in the large groups, counted: rule, t, missing, same (bits of
    the rules ``keyed`` whose compared column is equal), gamma_<i> of the columns compared by similarity, pairs."""
    kinds = list(config.comparisons.values())
    similar = [i for i, kind in enumerate(kinds) if kind != "exact"]
    one_table = right is None
    spans = [top_level(kinds[i]) + 2 for i in similar]
    names = ["rule", "t", "missing", "same", *(f"gamma_{i}" for i in similar)]
    schema = ", ".join(f"{c} int" for c in names) + ", pairs decimal(38,0)"
    out_schema = pa.schema([*((c, pa.int32()) for c in names), ("pairs", pa.decimal128(38, 0))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _read(batches)
        totals: dict[tuple[int, int], int] = {}
        rule, t = ((sides[0][c] or sides[1][c])[0] for c in ("rule", "t"))
        size = int(np.prod(spans)) << len(keyed)
        for a, b in _meetings(*sides, one_table):
            rows = {i: LevelRows(kinds[i], a[f"v{i}"], b[f"v{i}"]) for i in similar}
            missing_l, missing_r = (np.array(s["missing"], np.int64) for s in (a, b))
            all_missing = np.unique(missing_r)
            weight = np.array([float(w) for w in b["w"]])  # whole numbers far below 2^53
            starts = _starts(a, b, one_table)
            for i, start in enumerate(starts.tolist()):
                if start >= len(weight):
                    continue
                code = np.zeros(len(weight) - start, np.int64)
                for n, (rule_at, column) in enumerate(keyed.items()):
                    code |= rows[column].equal(i, start).astype(np.int64) << n
                base = 1 << len(keyed)
                for column, span in zip(similar, spans):
                    code += (rows[column].row(i, start).astype(np.int64) + 1) * base
                    base *= span
                own = int(a["w"][i])
                for other in all_missing.tolist():
                    here = weight[start:] if len(all_missing) == 1 else np.where(missing_r[start:] == other, weight[start:], 0.0)
                    sums = np.bincount(code, here, minlength=size)
                    for c in np.flatnonzero(sums).tolist():
                        key = (int(missing_l[i]) | other, c)
                        totals[key] = totals.get(key, 0) + own * int(sums[c])
        lines = []
        for (missing, c), pairs in totals.items():
            bits, c = c & ((1 << len(keyed)) - 1), c >> len(keyed)
            same = sum(1 << j for n, j in enumerate(keyed) if bits >> n & 1)
            gammas = []
            for span in spans:
                c, g = divmod(c, span)
                gammas.append(g - 1)
            lines.append((rule, t, missing, same, *gammas, Decimal(pairs)))
        columns = list(zip(*lines)) or [[] for _ in out_schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    tiles = _tiles(left, right, ["group"], large, ["_group"]).drop("group", "q")
    tile = ["_group", "_tile_l", "_tile_r"]
    return spread(tiles, *tile).groupBy(*tile).applyInArrow(count, schema)
