"""Types for all-text tables, picked from all values in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.plans.ids import quoted

# Cell texts that count as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_TRUTH = ("TRUE", "True", "true", "FALSE", "False", "false")


def null_out(df: DataFrame, na_values=NA_VALUES) -> DataFrame:
    """Missing-value tokens become null, before any type is picked."""
    return df.select(
        *[
            F.when(~F.col(quoted(c)).isin(*na_values), F.col(quoted(c))).alias(c)
            for c in df.columns
        ]
    )


def _as_whole(c):
    return c.rlike(r"^\s*[+-]?[0-9]+\s*$") & c.try_cast("bigint").isNotNull()


def _as_number(c):
    shape = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"
    return c.rlike(shape) & c.try_cast("double").isNotNull()


def pick_types(df: DataFrame) -> DataFrame:
    """bigint, double, boolean or string per column: the first that fits every non-null text.

    One aggregate over the whole table decides for all columns, so the types do not depend on a
    sample. A column without any value becomes double, as an all-missing numeric column would.
    """
    tests = []
    for i, name in enumerate(df.columns):
        c = F.col(quoted(name))
        tests += [
            F.count(c).alias(f"n{i}"),
            F.count_if(_as_whole(c)).alias(f"bigint{i}"),
            F.count_if(_as_number(c)).alias(f"double{i}"),
            F.count_if(c.isin(*_TRUTH)).alias(f"boolean{i}"),
        ]
    fits = df.agg(*tests).first()
    columns = []
    for i, name in enumerate(df.columns):
        n = fits[f"n{i}"]
        kind = next(
            (t for t in ("bigint", "double", "boolean") if n and fits[f"{t}{i}"] == n),
            "string" if n else "double",
        )
        columns.append(F.col(quoted(name)).try_cast(kind).alias(name))
    return df.select(*columns)


def unique_names(names: list[str | None]) -> list[str]:
    """Repeats get .1, .2, ...; blank headers are named by position."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for i, raw in enumerate(names):
        name = raw if raw not in (None, "") else f"Unnamed: {i}"
        base = name
        while name in out:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}.{seen[base]}"
        out.append(name)
    return out
