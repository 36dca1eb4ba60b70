"""The trained model: a few numbers per comparison level, kept as plain values."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.functions.compare import LEVELS


@dataclass(frozen=True)
class LinkModel:
    """``prior``: probability that two random records match. ``m`` and ``u``: per column, the
    share of each level (0 first) among matching and among random pairs. ``sessions``: per EM
    session, its blocking column, the rounds it took and whether it converged; empty for a model
    that was set by hand."""

    prior: float
    comparisons: dict[str, str]
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    sessions: tuple[tuple[str, int, bool], ...] = ()

    @property
    def converged(self) -> bool:
        return all(done for _, _, done in self.sessions)

    def weights(self, column: str) -> list[float]:
        return [math.log2(m / u) for m, u in zip(self.m[column], self.u[column])]

    @property
    def prior_weight(self) -> float:
        return math.log2(self.prior / (1.0 - self.prior))

    def weight_of(self, gamma: Column, column: str) -> Column:
        """Weight of one level as literals; a missing value says nothing."""
        out = F.when(gamma < 0, 0.0)
        for k, weight in enumerate(self.weights(column)):
            out = out.when(gamma == k, weight)
        return out

    def level_weight(self, i: int, column: str) -> Column:
        return self.weight_of(F.col(f"gamma_{i}"), column)

    def match_weight(self) -> Column:
        parts = [self.level_weight(i, c) for i, c in enumerate(self.comparisons)]
        return reduce(add, parts, F.lit(self.prior_weight))


def probability(weight: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(2.0), -weight))


def match_weights(spark: SparkSession, model: LinkModel) -> DataFrame:
    """How much each level of each comparison counts for or against a match."""
    rows = [
        (c, k, LEVELS[kind][k], model.m[c][k], model.u[c][k],
         model.m[c][k] / model.u[c][k], model.weights(c)[k])
        for c, kind in model.comparisons.items()
        for k in range(len(LEVELS[kind]))
    ]
    return spark.createDataFrame(
        rows,
        "comparison string, level int, label string, m double, u double, "
        "bayes_factor double, log2_weight double",
    )


def explain_pairs(scored: DataFrame, model: LinkModel) -> DataFrame:
    """One row per scored pair and comparison: its level and what that added to the weight."""
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("comparison"), F.col(f"gamma_{i}").alias("level"),
                _label(i, kind).alias("label"), model.level_weight(i, c).alias("log2_weight"),
            )
            for i, (c, kind) in enumerate(model.comparisons.items())
        ]
    )
    return scored.select("id_l", "id_r", F.inline(parts))


def _label(i: int, kind: str) -> Column:
    gamma = F.col(f"gamma_{i}")
    out = F.when(gamma < 0, "missing")
    for k, text in enumerate(LEVELS[kind]):
        out = out.when(gamma == k, text)
    return out
