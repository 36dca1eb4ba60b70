"""Records reduced to what linkage looks at, and copies merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.config import LinkConfig
from kindred.functions.text import cell_text, digest
from kindred.plans.ids import ROW_ID

# Columns of a record table: id, copies, _digest, then v<i> (value of compared column i) and
# k<j> (32-byte key of blocking column j, null if the value is).


def record_rows(rows: DataFrame, config: LinkConfig) -> DataFrame:
    """Row id, digest, values and blocking keys. A column compared for equality only is carried as
    its digest, so long texts never travel with pairs."""
    values = [
        _key(cell_text(rows, c)) if kind == "exact" else cell_text(rows, c)
        for c, kind in config.comparisons.items()
    ]
    keys = [_key(cell_text(rows, c)) for c in config.blocking_columns]
    seen = list(dict.fromkeys([*config.columns, *config.blocking_columns]))
    return rows.select(
        F.col(ROW_ID).alias("id"),
        digest([cell_text(rows, c) for c in seen]).alias("_digest"),
        *[v.alias(f"v{i}") for i, v in enumerate(values)],
        *[k.alias(f"k{j}") for j, k in enumerate(keys)],
    )


def _key(text):
    return F.when(text.isNotNull(), digest([text]))


def merge_copies(records: DataFrame) -> DataFrame:
    """One record per distinct combination of values, with the smallest id and the number of
    copies. All pairs of the same two combinations agree alike, so a group of copies that holds
    a large share of the table costs one record."""
    data = [c for c in records.columns if c not in ("id", "_digest")]
    return records.groupBy("_digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in data],
    )
