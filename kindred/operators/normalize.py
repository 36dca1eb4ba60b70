"""Column-wise normalisation as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.errors import CleaningError, one_of, require_columns
from kindred.functions.text import WHITE_SPACE, key_text


def _trim(c):
    return F.btrim(c, F.lit(WHITE_SPACE))


OPERATIONS = {
    "trim": _trim,
    "lowercase": F.lower,
    "email": lambda c: F.lower(_trim(c)),
    "phone": lambda c: F.regexp_replace(c, "[^0-9]", ""),
}


def normalize(df: DataFrame, config: dict[str, list[str]]) -> DataFrame:
    """Apply each column's operations in order; configured columns become non-null text."""
    require_columns(df, config)
    unknown = sorted({op for ops in config.values() for op in ops} - set(OPERATIONS))
    if unknown:
        raise CleaningError(one_of("Operation", ", ".join(unknown), OPERATIONS))
    columns = {}
    for name, ops in config.items():
        text = key_text(df, name)
        for op in ops:
            text = OPERATIONS[op](text)
        columns[name] = text
    return df.withColumns(columns) if columns else df
