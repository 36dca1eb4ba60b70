"""Comparison levels of two values: -1 if one side is missing, 0 for no agreement, up to equal.

Levels are tried from the top. Distances are taken on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from kindred.functions.distance import jaro_winklers

# Thresholds of the levels.
NAME_LEVELS = (0.92, 0.88, 0.70)
EMAIL_LEVEL = 0.88
MONTH_DAYS, YEAR_DAYS = 30.4375, 365.25

# Labels from level 0 upwards.
LEVELS = {
    "exact": ("different", "equal"),
    "name": (
        "different", "Jaro-Winkler >= 0.70", "Jaro-Winkler >= 0.88", "Jaro-Winkler >= 0.92", "equal",
    ),
    "email": (
        "different", "user part Jaro-Winkler >= 0.88", "Jaro-Winkler >= 0.88", "same user part",
        "equal",
    ),
    "phone": ("different", "Levenshtein <= 2", "Levenshtein <= 1", "equal"),
    "date": (
        "different", "within 10 years", "within 1 year", "within 1 month",
        "Damerau-Levenshtein <= 1", "equal",
    ),
}


# Types whose levels need a Python distance; the others are built-in expressions.
SLOW_TYPES = ("name", "email")


def top_level(kind: str) -> int:
    return len(LEVELS[kind]) - 1


def _levels(a: pa.Array, b: pa.Array, level_of) -> pa.Array:
    """Levels of the pairs left open; a null left side marks a pair that is already decided."""
    known = np.asarray(pc.and_(a.is_valid(), b.is_valid()))
    out = np.zeros(len(a), np.int32)
    if known.any():
        keep = pa.array(known)
        out[known] = level_of(a.filter(keep), b.filter(keep))
    return pa.array(out, mask=~known)


def name_levels(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Levels of different names, none missing."""
    score = jaro_winklers(x, y)
    return sum((score >= limit).astype(np.int32) for limit in NAME_LEVELS)


def email_levels(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Levels of addresses with different user parts, none missing."""
    def user(addresses):
        return pc.replace_substring_regex(addresses, pattern="(?s)@.*$", replacement="")

    by_user = jaro_winklers(user(x), user(y)) >= EMAIL_LEVEL
    return np.where(jaro_winklers(x, y) >= EMAIL_LEVEL, 2, np.where(by_user, 1, 0))


@arrow_udf(IntegerType())
def _name_level(a: pa.Array, b: pa.Array) -> pa.Array:
    return _levels(a, b, name_levels)


@arrow_udf(IntegerType())
def _email_level(a: pa.Array, b: pa.Array) -> pa.Array:
    return _levels(a, b, email_levels)


def _bytes_as_characters(c: Column) -> Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _name(a: Column, b: Column) -> Column:
    return F.when(a == b, 4).otherwise(_name_level(F.when(a != b, a), b))


def _email(a: Column, b: Column) -> Column:
    user_a, user_b = F.regexp_extract(a, "^[^@]+", 0), F.regexp_extract(b, "^[^@]+", 0)
    same_user = (user_a == user_b) & (user_a != "")
    return (
        F.when(a == b, 4)
        .when(same_user, 3)
        .otherwise(_email_level(F.when((a != b) & ~same_user, a), b))
    )


def _phone(a: Column, b: Column) -> Column:
    edits = F.levenshtein(_bytes_as_characters(a), _bytes_as_characters(b), 2)
    # looked up by -1 (more than two edits) to 2, so that they are counted once per pair
    return F.when(a == b, 3).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 2, 1))), edits + 2))


def _one_swap(a: Column, b: Column) -> Column:
    """Equal but for two neighbouring characters that changed places."""
    n = F.length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)),
            F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n),
        ) == b,
    )
    return (n == F.length(b)) & (n >= 2) & swapped


def _date(a: Column, b: Column) -> Column:
    day_a, day_b = (F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in (a, b))
    days = F.abs(F.datediff(day_a, day_b))
    text_a, text_b = _bytes_as_characters(a), _bytes_as_characters(b)
    return (
        F.when(day_a.isNull() | day_b.isNull(), -1)
        .when(a == b, 5)
        .when((F.levenshtein(text_a, text_b, 1) >= 0) | _one_swap(text_a, text_b), 4)
        .when(days <= MONTH_DAYS, 3)
        .when(days <= YEAR_DAYS, 2)
        .when(days <= 10 * YEAR_DAYS, 1)
        .otherwise(0)
    )


_BUILDERS = {
    "exact": lambda a, b: F.when(a == b, 1).otherwise(0),
    "name": _name,
    "email": _email,
    "phone": _phone,
    "date": _date,
}


def level(kind: str, a: Column, b: Column) -> Column:
    """Agreement level of two text columns."""
    return (
        F.when(a.isNull() | b.isNull(), -1).otherwise(_BUILDERS[kind](a, b)).cast("int")
    )
