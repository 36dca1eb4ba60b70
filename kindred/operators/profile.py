"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, MapType, StructType, ArrayType, VariantType

from kindred.functions.text import cell, digest
from kindred.plans.ids import quoted


def _null_share(df: DataFrame, name: str) -> Column:
    missing = F.count_if(cell(df, name).isNull())
    # bround: half to even; an empty table has no missing cells
    return F.coalesce(F.bround(F.try_divide(missing * 100.0, F.count(F.lit(1))), 2), F.lit(0.0))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, column, dtype, null_pct. One aggregate over one scan."""
    shares = df.agg(*[_null_share(df, c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"), F.col(f"_{i}").alias("null_pct"),
            )
            for i, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    return shares.select(F.inline(rows))


def _holds_map(dtype: DataType) -> bool:
    if isinstance(dtype, (MapType, VariantType)):
        return True
    if isinstance(dtype, StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, ArrayType) and _holds_map(dtype.elementType)


def _row_digest(df: DataFrame) -> Column:
    """Digest of a whole row, null equal to null. Maps are turned into text first: they cannot be
    grouped on."""
    texts = []
    for field in df.schema.fields:
        col = cell(df, field.name)
        nested = isinstance(field.dataType, (StructType, ArrayType)) or _holds_map(field.dataType)
        texts.append(F.to_json(col) if nested else col.cast("string"))
    return digest(texts)


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, exact_duplicates (copies beyond the first, over all columns).

    Rows are counted per digest, so 40 bytes per distinct row are shuffled, copies are merged
    before the shuffle, and both numbers come out of one pass.
    """
    groups = df.select(_row_digest(df).alias("_row")).groupBy("_row").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("exact_duplicates"),
    ).select("n_rows", F.lit(len(df.columns)).alias("n_cols"), "exact_duplicates")


def profile_table(df: DataFrame) -> dict:
    """Everything at once as plain values for display: two small jobs."""
    totals = profile_summary(df).first()
    columns = profile_columns(df).orderBy("position").collect()
    return {
        "n_rows": totals["n_rows"],
        "n_cols": len(df.columns),
        "columns": list(df.columns),
        "dtypes": dict(df.dtypes),
        "null_pct": {row["column"]: row["null_pct"] for row in columns},
        "exact_duplicates": totals["exact_duplicates"],
    }


def preview(df: DataFrame, n: int = 50, order_by: str | None = None) -> DataFrame:
    """First rows in id order (top-k, no full sort)."""
    name = order_by or ("_row_id" if "_row_id" in df.columns else None)
    return (df.orderBy(quoted(name)) if name else df).limit(n)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns both tables have, in the order of the first."""
    return [c for c in a.columns if c in b.columns]
