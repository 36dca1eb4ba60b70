"""Exact dedup: one row per key, the one with the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.errors import NO_KEYS, InvalidConfigError, require_columns
from kindred.functions.text import combined_key, digest, key_text
from kindred.operators.audit import DedupResult, Grouping, drop_rows
from kindred.plans.ids import ROW_ID, with_row_id


def check_keys(df: DataFrame, keys: list[str]) -> None:
    if not keys:
        raise InvalidConfigError(NO_KEYS)
    require_columns(df, keys, "Key column")


def duplicate_groups(keyed: DataFrame, by: str) -> DataFrame:
    """Groups with more than one row. Only min and count are kept per key, so partial
    aggregation shrinks a key that holds a third of the table before anything is shuffled."""
    return (
        keyed.groupBy(by)
        .agg(F.min(ROW_ID).alias("kept_index"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(by, "kept_index")
    )


def exact_rows(rows: DataFrame, keys: list[str]) -> DedupResult:
    """``dedup_exact`` for a table that has its row ids."""
    keyed = rows.select(ROW_ID, digest([key_text(rows, k) for k in keys]).alias("_digest"))
    removed = (
        keyed.join(duplicate_groups(keyed, "_digest"), "_digest")
        .where(F.col(ROW_ID) != F.col("kept_index"))
        .select("kept_index", F.col(ROW_ID).alias("removed_index"))
    )
    key_of_kept = rows.select(
        F.col(ROW_ID).alias("kept_index"), combined_key(rows, keys).alias("key")
    )
    return DedupResult(drop_rows(rows, ROW_ID, removed), Grouping(removed, key_of_kept, "exact"))


def dedup_exact(
    df: DataFrame, keys: list[str], id_col: str | None = None,
    order_by: str | list[str] | None = None, trusted: bool = False,
) -> DedupResult:
    """Keep the first row of each key; null counts as the empty string.

    Rows come in the order of ``id_col``, or of ``order_by`` (which must tell all rows apart), or
    as Spark reads them. Only (digest, id) is shuffled to find the groups. Whole rows move at most
    once, in the anti join, and not at all if the removed ids are few enough for AQE to broadcast.
    """
    check_keys(df, keys)
    return exact_rows(with_row_id(df, order_by, id_col, trusted), keys)
