"""Errors raised to the caller, wherever possible before any Spark job starts."""


# Messages used in more than one place.
NO_KEYS = "Name one or more key columns."
NO_ROWS = "There is nothing to read: the source has a header at most."


def one_of(what: str, value, valid) -> str:
    return f"{what} '{value}' is not known; use one of {list(valid)}."


class CleaningError(Exception):
    """Base of all errors this package raises on purpose."""


class EmptyDataError(CleaningError):
    """The source holds no data rows."""


class UnsupportedFormatError(CleaningError):
    """The path names a file type that cannot be read or written."""


class ColumnNotFoundError(CleaningError):
    """A configured column is missing from the table."""


class InvalidConfigError(CleaningError):
    """The configuration itself is wrong (unknown type, no columns, bad range)."""


def require_columns(df, columns, what="Column", table="the table"):
    """Check names against the schema only; no job is started."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ColumnNotFoundError(f"{what} {', '.join(map(repr, unknown))}: no such name in {table}. Available: {', '.join(df.columns)}.")
