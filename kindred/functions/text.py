"""Text of cells, match keys and key digests, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kindred.plans.ids import quoted

# The characters Python's str.strip() and str.split() treat as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
KEY_SEPARATOR = " | "

_WHITE_SPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


def cell(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into null."""
    col = F.col(quoted(name))
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return F.when(~F.isnan(col), col)
    return col


def cell_text(df: DataFrame, name: str) -> Column:
    """Text of a cell; null and NaN stay null."""
    return cell(df, name).cast("string")


def key_text(df: DataFrame, name: str) -> Column:
    """Text of a cell for normalising and keys: null becomes the empty string."""
    return F.coalesce(cell_text(df, name), F.lit(""))


def combined_key(df: DataFrame, keys: list[str]) -> Column:
    """One readable string per row. Coalesce first: concat_ws would skip nulls."""
    return F.concat_ws(KEY_SEPARATOR, *[key_text(df, k) for k in keys])


def digest(texts: list[Column]) -> Column:
    """32 bytes that stand for a tuple of nullable texts.

    Lengths are part of the digested text, so ('a', 'bc') and ('ab', 'c') differ, and a null
    differs from an empty string. Grouping on it shuffles 32 bytes, however long the texts are.
    """
    parts = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    # coalesce only tells the optimizer that it is never null, which saves a null filter (and
    # with it a second evaluation) below every join on the digest
    return F.coalesce(F.unhex(F.sha2(F.concat(*parts), 256)), F.lit(bytearray()))


def sorted_tokens(text: Column) -> Column:
    """Words in code-point order, one space between them."""
    words = F.filter(F.split(text, _WHITE_SPACE_RUN), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")
