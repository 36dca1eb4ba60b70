"""Audits: which row was kept, which were removed, why."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from kindred.errors import CleaningError
from kindred.plans.cut import cut_lineage
from kindred.plans.ids import number_rows

AUDIT_SCHEMA = (
    "group_id bigint, method string, key string, kept_index bigint, "
    "removed_indices string, n_duplicates bigint"
)
PROB_AUDIT_SCHEMA = AUDIT_SCHEMA + ", match_probability double"
AUDIT_COLUMNS = [f.split()[0] for f in AUDIT_SCHEMA.split(", ")]
PROB_AUDIT_COLUMNS = [f.split()[0] for f in PROB_AUDIT_SCHEMA.split(", ")]


class Grouping:
    """Groups of records of which one is kept; audit and members are built when they are asked for.

    ``removed``: kept_index, removed_index, one row per removed record. ``keys``: a row per
    kept_index (others may be present) with key and, for probabilistic audits, match_probability.
    """

    def __init__(
        self, removed: DataFrame, keys: DataFrame, method: str,
        order_by: list[str | Column] | None = None, first_group: int = 1,
    ):
        self._removed, self._keys, self.method = removed, keys, method
        self._order_by, self._first_group = order_by or ["kept_index"], first_group

    @cached_property
    def removed(self) -> DataFrame:
        return cut_lineage(self._removed)

    @cached_property
    def _numbered(self) -> DataFrame:
        groups = self.removed.groupBy("kept_index").agg(F.count(F.lit(1)).alias("n_duplicates"))
        return number_rows(
            groups.join(self._keys, "kept_index"), self._order_by, "group_id", start=self._first_group
        )

    @cached_property
    def members(self) -> DataFrame:
        """One row per removed record: the form to join with at scale."""
        numbered = self._numbered.select("kept_index", "group_id")
        return self.removed.join(numbered, "kept_index").select(
            "group_id", F.lit(self.method).alias("method"), "kept_index", "removed_index"
        )

    @cached_property
    def audit(self) -> DataFrame:
        """One row per group, whatever its size, with the removed ids as one text.

        A text holds at most 2 GB, about a hundred million ids; use ``members`` for larger groups.
        """
        listed = self.removed.groupBy("kept_index").agg(
            F.array_sort(F.collect_list("removed_index")).alias("_ids")
        )
        columns = PROB_AUDIT_COLUMNS if "match_probability" in self._keys.columns else AUDIT_COLUMNS
        return (
            listed.join(self._numbered, "kept_index")
            .withColumn("method", F.lit(self.method))
            .withColumn("removed_indices", F.array_join(F.col("_ids").cast("array<string>"), ","))
            .select(*columns)
        )

    def after(self, groups: int) -> Grouping:
        """The same with group numbers that go on from ``groups``."""
        return Grouping(self.removed, self._keys, self.method, self._order_by, groups + 1)


class DedupResult:
    """``clean``: the rows kept. ``members`` has one row per removed record, ``audit`` one per group.

    Only ``clean`` is planned at once; the others cost nothing unless they are asked for.
    """

    def __init__(self, clean: DataFrame, *groupings: Grouping):
        self.clean, self.groupings = clean, groupings

    @cached_property
    def _numbered_on(self) -> list[Grouping]:
        out, groups = [], 0
        for at, grouping in enumerate(self.groupings):
            out.append(grouping.after(groups) if groups else grouping)
            if at + 1 < len(self.groupings):
                groups += grouping.removed.agg(F.count_distinct("kept_index")).first()[0]
        return out

    @cached_property
    def members(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [g.members for g in self._numbered_on])

    @cached_property
    def audit(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [g.audit for g in self._numbered_on])


def drop_rows(df: DataFrame, row_id: str, members: DataFrame) -> DataFrame:
    """Survivors. The removed ids are the narrow side: few of them are broadcast by AQE, many
    are joined by shuffle."""
    removed = members.select(F.col("removed_index").alias(row_id))
    return df.join(removed, row_id, "left_anti")


def audit_members(audit: DataFrame) -> DataFrame:
    """Long form of any audit: one row per removed record."""
    removed = F.split("removed_indices", ",").cast("array<bigint>")
    return audit.select(
        "group_id", "method", "kept_index", F.explode(removed).alias("removed_index")
    )


def union_audits(*audits: DataFrame) -> DataFrame:
    """Stack audits of several runs; a missing match_probability becomes null."""
    if not audits:
        raise CleaningError("No audits to union.")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), audits)


def summary(rows: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows before, rows removed, rows left."""
    seen = rows.select(F.lit(1).alias("_in"), F.lit(0).alias("_out"))
    left = clean.select(F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    total = seen.unionAll(left).agg(
        F.coalesce(F.sum("_in"), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum("_out"), F.lit(0)).alias("n_out"),
    )
    return total.select("n_in", F.expr("n_in - n_out").alias("n_removed"), "n_out")
