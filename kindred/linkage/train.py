"""Training without labels: prior, u from random pairs, m by expectation maximisation.

Spark reduces the pairs to counts of agreement patterns. There are at most (levels + 2) to the
number of columns, times 2 to the number of blocking columns; only those counts reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kindred.config import LinkConfig
from kindred.errors import CleaningError
from kindred.functions.compare import top_level
from kindred.linkage.candidates import candidate_pairs, copy_pairs, with_levels
from kindred.linkage.hot import frequent_patterns, frequent_values, without_frequent
from kindred.linkage.model import LinkModel
from kindred.plans.ids import number_rows
from kindred.plans.pairs import TILE_ROWS

RECALL = 0.9
START_TOP = 0.95
LOWEST_M = 1e-9

_BIG = "decimal(38,0)"


def _pair_count(n: Column, n_other: Column | None = None) -> Column:
    n = n.cast("decimal(19,0)")
    if n_other is not None:
        return (n * n_other.cast("decimal(19,0)")).cast(_BIG)
    return (n * (n - 1) / 2).cast(_BIG)


def equal_pairs(
    left: DataFrame, right: DataFrame | None, columns: list[str]
) -> dict[str, tuple[int, int]]:
    """Per column, the pairs with equal values and the pairs without a missing value.

    Counted from group sizes, so no pair is made, however large a group is."""
    def side(records: DataFrame, n_l: Column, n_r: Column) -> DataFrame:
        values = [F.struct(F.lit(c).alias("column"), F.xxhash64(c).alias("h1"), F.md5(F.col(c)).alias("h2"),
                           F.col(c).isNotNull().alias("known")) for c in columns]
        one = records.select(F.inline(F.array(*values)), n_l.alias("n_l"), n_r.alias("n_r"))
        return one.where("known")

    copies, none = F.col("copies"), F.lit(0).cast("bigint")
    rows = side(left, copies, none)
    if right is not None:
        rows = rows.unionAll(side(right, none, copies))
    groups = rows.groupBy("column", "h1", "h2").agg(F.sum("n_l").alias("n_l"), F.sum("n_r").alias("n_r"))
    other = None if right is None else F.col("n_r")
    sums = groups.groupBy("column").agg(
        F.sum(_pair_count(F.col("n_l"), other)).alias("equal"), F.sum("n_l").alias("n_l"), F.sum("n_r").alias("n_r")
    ).collect()  # one row per compared column
    out = {c: (0, 0) for c in columns}
    for r in sums:
        known = all_pairs_of(int(r["n_l"]), None if right is None else int(r["n_r"]))
        out[r["column"]] = (int(r["equal"] or 0), known)
    return out


def all_pairs_of(n_left: int, n_right: int | None) -> int:
    return n_left * (n_left - 1) // 2 if n_right is None else n_left * n_right


def estimate_prior(agreeing: int, total: int, recall: float = RECALL) -> float:
    return min(max(agreeing / recall / total, 1e-12), 1.0 - 1e-6)


def _sample(rows: DataFrame, n: int, size: int, seed: int, name: str) -> DataFrame:
    """``size`` rows chosen by a hash of id and seed: the same ones however the table is split."""
    rank = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    kept = rows if n <= size else rows.orderBy(rank, "id").limit(size)
    values = [c for c in rows.columns if c.startswith("v")]
    return number_rows(kept.select("id", *values), ["id"], name).drop("id")


def random_patterns(
    left: DataFrame, n_left: int, right: DataFrame | None, n_right: int | None,
    config: LinkConfig,
) -> DataFrame:
    """Agreement patterns of all pairs of a sample of rows; of all rows if those are few.

    The pairs are numbered 0, 1, ... and each number is turned into two positions, so the pairs
    come from a range and two joins on the position with a sample of fixed size. That size is in
    rows, not in bytes, so whether the sample is broadcast is left to AQE.
    """
    max_pairs = config.random_pairs
    if right is None:
        size = min(n_left, (1 + math.isqrt(1 + 8 * max_pairs)) // 2)
        n_pairs = size * (size - 1) // 2
        side_l = side_r = _sample(left, n_left, size, config.seed, "_at")
        k = F.col("id").cast("double")
        guess = F.floor((1 + F.sqrt(1 + 8 * k)) / 2).cast("bigint")
        low = (guess * (guess - 1) / 2).cast("bigint")
        hi = F.when(low > F.col("id"), guess - 1).otherwise(guess)
        at_l, at_r = (F.col("id") - (hi * (hi - 1) / 2).cast("bigint")), hi
    else:
        size_l = min(n_left, max(math.isqrt(max_pairs), max_pairs // max(n_right, 1)))
        size_r = min(n_right, max_pairs // size_l)
        n_pairs = size_l * size_r
        side_l = _sample(left, n_left, size_l, config.seed, "_at")
        side_r = _sample(right, n_right, size_r, config.seed, "_at")
        at_l, at_r = (F.col("id") / size_r).cast("bigint"), F.col("id") % size_r
    spark = left.sparkSession
    numbers = spark.range(0, n_pairs, 1, spark.sparkContext.defaultParallelism)
    pairs = numbers.select(at_l.alias("_at_l"), at_r.alias("_at_r"))
    for side, suffix in ((side_l, "l"), (side_r, "r")):
        lookup = side.select(*[F.col(c).alias(f"{c}_{suffix}") for c in side.columns])
        pairs = pairs.join(lookup, f"_at_{suffix}")
    ones = [F.lit(1).alias(c) for c in ("id_l", "id_r", "copies_l", "copies_r", "match_key")]
    keys = [F.lit(None).cast("binary").alias(f"k{j}_{s}")
            for j in range(len(config.blocking_columns)) for s in "lr"]
    values = [c for c in pairs.columns if c.startswith("v")]
    levels = with_levels(pairs.select(*values, *ones, *keys), config)
    return _count_patterns(levels, config)


def _count_patterns(levels: DataFrame, config: LinkConfig, one_table: bool = True) -> DataFrame:
    gammas = [f"gamma_{i}" for i in range(len(config.comparisons))]
    # ids of two tables say nothing about each other
    same = F.lit(one_table) & (F.col("id_l") == F.col("id_r"))
    n = F.when(same & (F.col("copies_l") > 1), _pair_count(F.col("copies_l"))).otherwise(
        _pair_count(F.col("copies_l"), F.col("copies_r"))
    )
    return levels.groupBy("agree", *gammas).agg(F.sum(n).alias("pairs"))


def blocked_patterns(
    left: DataFrame, right: DataFrame | None, config: LinkConfig, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Agreement patterns of all candidate pairs. Pairs are compared and counted where the join
    makes them; what is shuffled is at most one row per pattern and task. Values that very many
    records share make no pairs (see ``linkage.hot``)."""
    frequent = frequent_values(left, right, config)
    hot = not frequent.isEmpty()
    n_rules = len(config.blocking_columns)
    if hot:
        cold_left = without_frequent(left, frequent, n_rules)
        cold_right = None if right is None else without_frequent(right, frequent, n_rules)
        pairs = candidate_pairs(cold_left, cold_right, n_rules, tile_rows, join_on="c")
        pairs = pairs.drop(*[f"c{j}_{s}" for j in range(n_rules) for s in "lr"])
    else:
        pairs = candidate_pairs(left, right, n_rules, tile_rows)
    if right is None:
        pairs = pairs.unionByName(copy_pairs(left))
    counts = _count_patterns(with_levels(pairs, config), config, right is None)
    if not hot:
        return counts
    gammas = [f"gamma_{i}" for i in range(len(config.comparisons))]
    both = counts.unionByName(frequent_patterns(left, right, frequent, config, tile_rows))
    return both.groupBy("agree", *gammas).agg(F.sum("pairs").alias("pairs"))


class Patterns:
    """Collected pattern counts as arrays."""

    def __init__(self, rows, n_comparisons: int):
        self.gamma = np.array(
            [[r[f"gamma_{i}"] for i in range(n_comparisons)] for r in rows], np.int64
        ).reshape(len(rows), n_comparisons)
        self.agree = np.array([r["agree"] for r in rows], np.int64)
        self.pairs = np.array([float(r["pairs"]) for r in rows])

    def where(self, keep: np.ndarray) -> Patterns:
        out = object.__new__(Patterns)
        out.gamma, out.agree, out.pairs = self.gamma[keep], self.agree[keep], self.pairs[keep]
        return out

    def level_counts(self, i: int, levels: int, weight=None) -> np.ndarray:
        known = self.gamma[:, i] >= 0
        w = self.pairs if weight is None else weight
        return np.bincount(self.gamma[known, i], w[known], minlength=levels)


def u_shares(
    patterns: Patterns, config: LinkConfig, equal: dict[str, tuple[int, int]]
) -> dict[str, np.ndarray]:
    """Share of each level among random pairs: of equality from ``equal`` (exact counts over all
    pairs), of the levels below from the sampled patterns, in proportion."""
    floor = 0.5 / max(patterns.pairs.sum(), 1.0)
    out = {}
    for i, (column, kind) in enumerate(config.comparisons.items()):
        top = top_level(kind)
        counts = patterns.level_counts(i, top + 1)
        same, known = equal[f"v{i}"]
        share = same / max(known, 1)
        below = counts[:top].sum()
        lower = counts[:top] / below * (1.0 - share) if below else counts[:top] * 0.0
        out[column] = np.maximum(np.append(lower, share), floor)
    return out


def start_m(kind: str) -> np.ndarray:
    top = top_level(kind)
    return np.append(np.full(top, (1.0 - START_TOP) / top), START_TOP)


def em_session(
    patterns: Patterns, config: LinkConfig, u: dict[str, np.ndarray], fixed: str | None,
    odds: float,
) -> tuple[dict[str, np.ndarray], int, bool]:
    """m of the columns that are free among pairs equal on one column (``fixed``, if compared),
    the rounds it took, and whether it converged.

    Levels no pair shows come back as nan.
    """
    free = [(i, c) for i, c in enumerate(config.columns) if c != fixed]
    m = {c: start_m(config.comparisons[c]) for _, c in free}
    prior = odds / (1.0 + odds)
    total = patterns.pairs.sum()
    rounds, converged = 0, False
    for rounds in range(1, config.em_rounds + 1):
        logit = np.full(len(patterns.pairs), math.log(prior / (1.0 - prior)))
        for i, c in free:
            ratio = np.append(np.log(m[c] / u[c]), 0.0)  # index -1: missing
            logit += ratio[patterns.gamma[:, i]]
        matching = patterns.pairs / (1.0 + np.exp(-logit))
        new_prior = min(max(matching.sum() / total, 1e-12), 1.0 - 1e-12)
        change = abs(new_prior - prior)
        prior = new_prior
        for i, c in free:
            counts = patterns.level_counts(i, len(m[c]), matching)
            if counts.sum() > 0:
                new = np.maximum(counts / counts.sum(), LOWEST_M)
                change = max(change, float(np.abs(new - m[c]).max()))
                m[c] = new
        if change < config.tolerance:
            converged = True
            break
    for i, c in free:
        unseen = patterns.level_counts(i, len(m[c])) == 0
        m[c] = np.where(unseen, np.nan, m[c])
    return m, rounds, converged


def combine_sessions(sessions: list[dict], config: LinkConfig) -> dict[str, list[float]]:
    """Median over the sessions, start value where no session saw the level, renormalised."""
    out = {}
    for column, kind in config.comparisons.items():
        start = start_m(kind)
        seen = [s[column] for s in sessions if column in s]
        if seen:
            stacked = np.array(seen)
            unseen = np.isnan(stacked).all(axis=0)
            stacked[:, unseen] = start[unseen]
            shares = np.maximum(np.nanmedian(stacked, axis=0), LOWEST_M)
        else:
            shares = start
        out[column] = (shares / shares.sum()).tolist()
    return out


def agreeing_per_key(patterns: Patterns, n_keys: int) -> list[int]:
    """Candidate pairs equal on each blocking column."""
    return [int(patterns.pairs[(patterns.agree >> j) & 1 == 1].sum()) for j in range(n_keys)]


def train(
    left: DataFrame, rows_left: DataFrame, right: DataFrame | None, rows_right: DataFrame | None,
    config: LinkConfig, tile_rows: int = TILE_ROWS,
) -> LinkModel:
    """``left``/``right``: records with copies merged; ``rows_*``: the same before merging.

    The pattern counts of the candidate pairs say everything: how many pairs agree on some
    blocking column (the prior), on which, and how the other columns agree among them (EM).
    """
    names, n = config.blocking_columns, len(config.comparisons)
    n_left = left.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    n_right = None
    if right is not None:
        n_right = right.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    total = all_pairs_of(n_left, n_right)
    patterns = Patterns(blocked_patterns(left, right, config, tile_rows).collect() if total else [], n)
    per_key = agreeing_per_key(patterns, len(names))
    trainable = [j for j, pairs in enumerate(per_key) if pairs]
    if not trainable:
        raise CleaningError(
            "The model cannot be trained: no two records are equal in any blocking column."
        )
    if not any(set(config.columns) - {names[j]} for j in trainable):
        raise CleaningError(
            "The model cannot be trained: nothing is compared but the blocking column itself."
        )
    prior = estimate_prior(int(patterns.pairs.sum()), total)
    sampled = Patterns(random_patterns(rows_left, n_left, rows_right, n_right, config).collect(), n)
    u = u_shares(sampled, config, equal_pairs(left, right, [f"v{i}" for i in range(n)]))
    sessions, log = [], []
    for j in trainable:
        column = names[j]
        by_chance = u[column][-1] if column in config.comparisons else per_key[j] / total
        odds = prior / (1.0 - prior) * START_TOP / by_chance
        within = patterns.where((patterns.agree >> j) & 1 == 1)
        m, rounds, converged = em_session(within, config, u, column, odds)
        sessions.append(m)
        log.append((column, rounds, converged))
    return LinkModel(
        prior, dict(config.comparisons), combine_sessions(sessions, config),
        {c: shares.tolist() for c, shares in u.items()}, tuple(log),
    )
