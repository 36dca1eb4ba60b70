"""Candidate pairs: records that agree on at least one blocking column."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kindred.config import LinkConfig
from kindred.functions.compare import SLOW_TYPES, level
from kindred.linkage.grid import grid_pairs, large_groups, suits_grid
from kindred.linkage.model import LinkModel
from kindred.plans.pairs import TILE_ROWS, alike, join_lists, join_pairs, largest_groups

LIST_GAIN = 8  # rows alike on average from which lists of ids pay


def _side(records: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    renamed = records.drop("_digest").select(
        *[F.col(c).alias(f"{c}_{suffix}") for c in records.columns if c != "_digest"]
    )
    named = {f"_key{n}": F.col(f"{key}_{suffix}") for n, key in enumerate(keys)}
    return renamed.withColumns(named).dropna(subset=list(named))


def _equal(key: str) -> Column:
    return F.coalesce(F.col(f"{key}_l") == F.col(f"{key}_r"), F.lit(False))


def candidate_pairs(
    left: DataFrame, right: DataFrame | None, n_rules: int, tile_rows: int = TILE_ROWS,
    also_equal: list[list[list[str]]] | None = None, join_on: str = "k",
    without: dict[tuple[int, int], DataFrame] | None = None, ids_only: bool = False, gather: bool = False,
) -> DataFrame:
    """Every pair once, with ``match_key`` (the first rule it satisfies).

    One equi-join per rule; rule k leaves out pairs an earlier rule has made, so the union needs
    no distinct. One join on an OR of the rules would compare everything with everything.
    ``right`` None: pairs within ``left``, smaller id first.

    ``join_on``: prefix of the columns to join on, k or c (see ``without_frequent``).
    ``also_equal``: per rule, sets of further columns of which one must be equal as a whole (see
    ``needed_agreement``); each set is a join of its own on the longer key. ``without``: keys to leave
    out of such a join, by rule and set.

    ``ids_only``: just id_l, id_r and match_key, so a join carries no more than the rules before it ask for.
    ``gather``: in large groups, records that are alike but for their ids travel as lists (``join_lists``), if
    there are many. Ids must not be null then.
    """
    gather = gather or ids_only
    same = right is None
    rule_keys = [f"{join_on}{rule}" for rule in range(n_rules)]
    largest = largest_groups(left, rule_keys)
    if not same:
        largest = list(map(max, largest, largest_groups(right, rule_keys)))
    parts = []
    for rule in range(n_rules):
        # a longer key has no larger groups than the rule's own
        tiles = tile_rows if largest[rule] > tile_rows else None
        sets = [[]] if also_equal is None else also_equal[rule]
        for at, columns in enumerate(sets):
            keys = [f"{join_on}{rule}", *columns]
            names = [f"_key{n}" for n in range(len(keys))]
            sides = _side(left, "l", keys), _side(left if same else right, "r", keys)
            if ids_only:
                asked = ["id", *(f"k{earlier}" for earlier in range(rule)), *(c for made in sets[:at] for c in made)]
                sides = [s.select(*names, *dict.fromkeys(f"{c}_{side}" for c in asked)) for s, side in zip(sides, "lr")]
            if without and (rule, at) in without:
                sides = [s.join(without[rule, at].select(*names), names, "left_anti").select(s.columns) for s in sides]
            if tiles is not None and gather and min(alike(s, f"id_{side}") for s, side in zip(sides, "lr")) >= LIST_GAIN:
                pairs = join_lists(*sides, names, "id_l", "id_r", same, tiles).drop(*names)
            else:
                pairs = join_pairs(*sides, names, "id_l", "id_r", same, tiles).drop(*names)
            for earlier in range(rule):
                pairs = pairs.where(~_equal(f"k{earlier}"))
            for made in sets[:at]:
                pairs = pairs.where(~reduce(Column.__and__, [_equal(c) for c in made]))
            if ids_only:
                pairs = pairs.select("id_l", "id_r")
            parts.append(pairs.withColumn("match_key", F.lit(rule)))
    if not parts:
        none = candidate_pairs(left.limit(0), None if same else right.limit(0), 1, ids_only=ids_only)
        return none
    return reduce(DataFrame.unionByName, parts)


def candidate_levels(
    left: DataFrame, right: DataFrame | None, n_rules: int, config: LinkConfig, tile_rows: int = TILE_ROWS,
    also_equal: list[list[list[str]]] | None = None, model: LinkModel | None = None, threshold: float | None = None,
) -> DataFrame:
    """``with_levels`` of the ``candidate_pairs``; with a model, of those ``within_reach`` of the threshold.

    Groups that make very many pairs with text to compare do so in tiles (see ``linkage.grid``)."""
    large = {}
    if suits_grid(config):
        for rule in range(n_rules):
            for at, columns in enumerate([[]] if also_equal is None else also_equal[rule]):
                keys = [f"k{rule}", *columns]
                found = large_groups(left, right, keys, [f"_key{n}" for n in range(len(keys))])
                if not found.isEmpty():
                    large[rule, at] = found
    # values compared for equality only are digests: records may well be alike in them, and none is long
    gather = all(kind == "exact" for kind in config.comparisons.values())
    pairs = candidate_pairs(left, right, n_rules, tile_rows, also_equal, without=large, gather=gather)
    if model is not None:
        pairs = within_reach(pairs, config, model, threshold)
    parts = [with_levels(pairs, config)]
    for (rule, at), found in large.items():
        sets = [[]] if also_equal is None else also_equal[rule]
        keys = [f"k{rule}", *sets[at]]
        parts.append(grid_pairs(
            left, right, keys, found, [f"_key{n}" for n in range(len(keys))], config, rule, sets[:at], model,
            0.0 if model is None else _needed_weight(threshold),
        ))
    return reduce(DataFrame.unionByName, parts)


def rule_forecast(left: DataFrame, right: DataFrame | None, n_rules: int) -> DataFrame:
    """How many pairs ``candidate_pairs`` makes per rule, counted before any pair is made.

    ``equal_pairs``: pairs equal on the rule's own column. ``n_pairs``: those that no earlier rule
    has made, whose sum is the size of the union. Inclusion and exclusion over the sets of rules:
    a record counts once for every set of columns of which none is missing, in groups of equal
    values, and a group only needs its size. Two hashes per record and set are shuffled at most.
    """
    def counted(records: DataFrame, n_l: int, n_r: int) -> DataFrame:
        sets = []
        for mask in range(1, 1 << n_rules):
            members = [F.col(f"k{j}") for j in range(n_rules) if mask >> j & 1]
            known = reduce(Column.__and__, [k.isNotNull() for k in members])
            key = F.struct(F.lit(mask).alias("mask"), F.xxhash64(*members).alias("h1"),
                           F.md5(F.concat(*members)).alias("h2"))
            sets.append(F.when(known, key))
        one = records.select(F.explode(F.array_compact(F.array(*sets))).alias("of"))
        return one.select("of.*", F.lit(n_l).cast("bigint").alias("n_l"), F.lit(n_r).cast("bigint").alias("n_r"))

    rows = counted(left, 1, 0)
    if right is not None:
        rows = rows.unionAll(counted(right, 0, 1))
    groups = rows.groupBy("mask", "h1", "h2").agg(F.sum("n_l").alias("l"), F.sum("n_r").alias("r"))
    n_l, n_r = (F.col(c).cast("decimal(19,0)") for c in "lr")
    made = n_l * (n_l - 1) / 2 if right is None else n_l * n_r
    sums = groups.groupBy("mask").agg(F.sum(made.cast("decimal(38,0)")).alias("pairs"))
    # a set counts for its last rule: what that rule adds to the union of those before it
    signed = F.when(F.bit_count("mask") % 2 == 1, F.col("pairs")).otherwise(-F.col("pairs"))
    rule = F.floor(F.log2(F.col("mask").cast("double"))).cast("int")
    per_rule = sums.groupBy(rule.alias("match_key")).agg(
        F.max(F.when(F.bit_count("mask") == 1, F.col("pairs"))).alias("equal_pairs"), F.sum(signed).alias("n_pairs")
    )
    rules = left.sparkSession.range(n_rules).select(F.col("id").cast("int").alias("match_key"))
    zero = F.lit(0).cast("decimal(38,0)")
    return rules.join(per_rule, "match_key", "left").select(
        "match_key", *(F.coalesce(F.col(c).cast("decimal(38,0)"), zero).alias(c) for c in ("equal_pairs", "n_pairs"))
    )


def needed_agreement(
    config: LinkConfig, model: LinkModel, threshold: float
) -> list[list[list[str]]]:
    """What a pair must have in common, beyond a rule's own column, to be able to pass.

    With some columns equal and all others at their best level short of equal, the weight either
    can reach the threshold or cannot. Columns without which it never can must all be equal: one
    join on the rule's key and those. Without such columns, if at least s of the n others must be
    equal, any n - s + 1 of them hold an equal one: a join on the rule's key and each of the
    rarest of these. So a rule has n joins at most, however many columns there are, and a weak
    column that many records share (a city, a language) only makes pairs together with another.
    """
    names = config.columns
    need = _needed_weight(threshold)
    best = [max(0.0, *model.weights(c)[:-1]) for c in names]
    gain = [max(0.0, model.weights(c)[-1] - b) for b, c in zip(best, names)]
    out = []
    for column in config.blocking_columns:
        own = {names.index(column)} if column in names else set()
        rest = [i for i in range(len(names)) if i not in own]
        base = model.prior_weight + sum(best) + sum(gain[i] for i in own)
        whole = base + sum(gain[i] for i in rest)
        if whole < need:
            out.append([])
            continue
        always = [i for i in rest if whole - gain[i] < need]
        if always:
            out.append([[f"v{i}" for i in always]])
            continue
        reach, s = base, 0
        for i in sorted(rest, key=lambda i: -gain[i]):
            if reach >= need:
                break
            reach, s = reach + gain[i], s + 1
        rare = sorted(rest, key=lambda i: (model.u[names[i]][-1], i))
        out.append([[]] if s == 0 else [[f"v{i}"] for i in rare[: len(rest) - s + 1]])
    return out


def _needed_weight(threshold: float) -> float:
    """Rounding differences must not decide before the score does."""
    return math.log2(threshold / (1.0 - threshold)) - 1e-6


def with_levels(pairs: DataFrame, config: LinkConfig) -> DataFrame:
    """Ids, copies, match_key, ``agree`` (bit j: equal on blocking column j) and ``gamma_<i>``."""
    agree = reduce(
        Column.bitwiseOR,
        [
            F.when(_equal(f"k{j}"), F.lit(1 << j)).otherwise(F.lit(0))
            for j in range(len(config.blocking_columns))
        ],
    )
    return pairs.select(
        "id_l", "id_r", "copies_l", "copies_r", "match_key", agree.alias("agree"),
        *[
            level(kind, F.col(f"v{i}_l"), F.col(f"v{i}_r")).alias(f"gamma_{i}")
            for i, kind in enumerate(config.comparisons.values())
        ],
    )


def copy_pairs(records: DataFrame) -> DataFrame:
    """Records with copies, paired with themselves; stands for all pairs among the copies."""
    copied = records.where("copies > 1").drop("_digest")
    keys = [c for c in copied.columns if c.startswith("k")]
    agrees = reduce(Column.__or__, [F.col(k).isNotNull() for k in keys])
    first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(j)) for j, k in enumerate(keys)])
    return copied.where(agrees).select(
        *[F.col(c).alias(f"{c}_l") for c in copied.columns],
        *[F.col(c).alias(f"{c}_r") for c in copied.columns],
        first.alias("match_key"),
    )


def within_reach(
    pairs: DataFrame, config: LinkConfig, model: LinkModel, threshold: float
) -> DataFrame:
    """Drop pairs that miss the threshold whatever their names and addresses say.

    Only built-in comparisons are looked at, the others count with their best level, so most pairs
    of a large group never leave the JVM. Nothing that could pass is lost.
    """
    if not any(kind in SLOW_TYPES for kind in config.comparisons.values()):
        return pairs
    reachable = F.lit(model.prior_weight)
    for i, (column, kind) in enumerate(config.comparisons.items()):
        a, b = F.col(f"v{i}_l"), F.col(f"v{i}_r")
        if kind in SLOW_TYPES:
            best = max(0.0, *model.weights(column)[:-1])
            top = model.weights(column)[-1]
            weight = F.when(a.isNull() | b.isNull(), 0.0).when(a == b, top).otherwise(best)
        else:
            weight = model.weight_of(level(kind, a, b), column)
        reachable = reachable + weight
    return pairs.where(reachable >= _needed_weight(threshold))
