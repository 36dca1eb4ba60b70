"""Row identity: dense numbers that do not depend on how the table is partitioned."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from kindred.errors import InvalidConfigError, require_columns
from kindred.plans.cut import cut_lineage

ROW_ID = "_row_id"

# monotonically_increasing_id keeps the partition in the upper 31 bits.
_POSITION_BITS = 33


def number_rows(df: DataFrame, order_by: list, name: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the order of ``order_by``.

    A range sort spreads the rows over all executors; one count per partition is all the driver
    sees, and each row adds its own position to the start of its partition. There is no window
    without a partition key, hence no single task that sees every row.
    """
    return _number_in_place(df.orderBy(*order_by), name, start)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _number_in_place(df: DataFrame, name: str, start: int) -> DataFrame:
    """Positions are written together with the rows before anything else is planned on top, so
    neither a recomputed task nor a pushed-down filter can change them."""
    pos, part_name, start_name = (fresh(df, c) for c in ("_pos", "_part", "_start"))
    rows = cut_lineage(df.withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(quoted(pos), _POSITION_BITS)
    within = F.col(quoted(pos)).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = dict(rows.groupBy(part.alias("p")).count().collect())
    parts = sorted(sizes)
    if len(parts) <= 1:
        return rows.withColumn(name, within + F.lit(start)).drop(pos)
    offsets = list(accumulate((sizes[p] for p in parts), initial=start))
    # one row per partition of the table, so small enough to broadcast whatever the table holds
    starts = F.broadcast(
        rows.sparkSession.createDataFrame(
            list(zip(parts, offsets)), f"{part_name} bigint, {start_name} bigint"
        )
    )
    return (
        rows.withColumn(part_name, part)
        .join(starts, part_name)
        .withColumn(name, within + F.col(start_name))
        .drop(pos, part_name, start_name)
    )


def with_row_id(
    df: DataFrame, order_by: str | list[str] | None = None, id_col: str | None = None,
    trusted: bool = False,
) -> DataFrame:
    """Add ``_row_id``: the table's own key if it has one, else dense numbers from 0.

    ``id_col`` names a unique integer column; prefer it on large tables. One narrow aggregation
    makes sure that it holds no null and no repeat, since either would leave duplicates in or
    take kept rows out; ``trusted`` skips that. A column of the table that happens to be called
    ``_row_id`` is only taken for the id if ``id_col`` says so.
    ``order_by`` numbers the rows in that order; it must tell all rows apart for the ids to be
    repeatable. With neither, the rows are numbered in the order Spark reads them and written
    once, since a re-read may come back in another order.
    """
    if id_col is not None:
        require_columns(df, [id_col], "Id column")
        if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise InvalidConfigError(f"Id column '{id_col}' must hold whole numbers.")
        if not trusted:
            _require_unique(df, id_col)
        return df.withColumn(ROW_ID, F.col(quoted(id_col)).cast("bigint"))
    if ROW_ID in df.columns:
        raise InvalidConfigError(
            f"The table already has a column '{ROW_ID}': pass id_col='{ROW_ID}' to use it, or rename it."
        )
    if order_by is not None:
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        require_columns(df, names, "Order column")
        return number_rows(df, [F.col(quoted(c)) for c in names], ROW_ID)
    return _number_in_place(df, ROW_ID, 0)


def _require_unique(df: DataFrame, id_col: str) -> None:
    ids = df.select(F.col(quoted(id_col)).alias("id"))
    bad = ids.groupBy("id").count().where("id IS NULL OR count > 1").head(1)
    if bad:
        raise InvalidConfigError(
            f"Id column '{id_col}' holds " + ("null." if bad[0]["id"] is None else f"{bad[0]['id']} more than once.")
        )


def quoted(name: str) -> str:
    """Column name safe for F.col even if it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"
