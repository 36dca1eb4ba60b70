"""Tables by file type: read, write, and the checks around both."""

from __future__ import annotations

import os
import uuid
from itertools import accumulate
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kindred.errors import (
    NO_ROWS, CleaningError, EmptyDataError, InvalidConfigError, UnsupportedFormatError, one_of,
)
from kindred.plans.ids import ROW_ID, fresh, quoted
from kindred.sources.typing import NA_VALUES, null_out, pick_types, unique_names
from kindred.sources.workbook import read_workbooks, workbook_catalog

_READABLE = (".csv", ".parquet", ".json", ".orc", ".xlsx")
_WRITABLE = (".csv", ".parquet")

# One row per file, about 200 bytes with the path.
_BROADCAST_FILES = 100_000


def _extension(path: str) -> str:
    return os.path.splitext(urlparse(str(path)).path.rstrip("/*"))[1].lower()


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyDataError(NO_ROWS)
    return df


def read_csv(
    spark: SparkSession, path: str, multi_line: bool = False, na_values=NA_VALUES,
    encoding: str = "UTF-8", schema: StructType | str | None = None,
) -> DataFrame:
    """CSV with a header row. Cells are read as text, missing-value tokens become null, then types
    are picked from all values, or cast to those of ``schema``, which needs one scan only (and a
    value that is not of its type fails).

    All files of a folder must have the same header; another order of columns is an error, not
    other data. Headers with blank or repeated names are compared in a scan of their own.
    ``multi_line`` allows line breaks inside quoted cells, but makes every file one task, so it is
    off for large input.
    """
    options = {"multiLine": multi_line, "escape": '"', "encoding": encoding, "quote": '"'}
    if schema is not None:
        typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        text = StructType([StructField(f.name, StringType()) for f in typed])
        raw = spark.read.options(**options, mode="FAILFAST").schema(text).csv(
            path, header=True, enforceSchema=False
        )
        raw = null_out(raw, na_values)
        return raw.select(*(F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in typed))
    head = spark.read.options(**options).csv(path, header=False)
    if not head.columns:
        raise EmptyDataError(NO_ROWS)
    header = head.first()
    if header is None:
        raise EmptyDataError(NO_ROWS)
    names = unique_names(list(header))
    schema = StructType([StructField(n, StringType()) for n in names])
    # names that were made up are in no file, so Spark can't compare the headers with them
    renamed = names != list(header)
    if renamed and _headers_differ(spark, path, len(names), options):
        raise CleaningError(f"The files of {path} have different headers.")
    raw = spark.read.options(**options, mode="FAILFAST").schema(schema).csv(
        path, header=True, enforceSchema=renamed
    )
    try:
        require_rows(raw)
        return pick_types(null_out(raw, na_values))
    except Exception as error:
        if "CSV header does not conform" in str(error):
            raise CleaningError(f"The files of {path} have different headers.") from error
        if "MALFORMED_RECORD" in str(error) or "FAILED_READ_FILE" in str(error):
            hint = "" if multi_line else " If cells hold line breaks, pass multi_line=True."
            raise CleaningError(f"Could not read {path} as CSV.{hint}") from error
        raise


def _headers_differ(spark: SparkSession, path: str, width: int, options: dict) -> bool:
    """Whether the first rows of the files are not all equal; one more column than the header of
    the first file shows those that are longer. One row per file is shuffled."""
    cells = [StructField(f"c{i}", StringType()) for i in range(width + 1)]
    rows = spark.read.options(**options, mode="PERMISSIVE").schema(StructType(cells)).csv(path, header=False)
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"), F.to_json(F.array(*[f.name for f in cells])).alias("row"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("at"),
    )
    first = placed.groupBy("file").agg(F.min_by("row", "at").alias("header"))
    return first.select("header").distinct().limit(2).count() > 1


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with ``_row_id``: dense numbers from 0, in the order of files by path and of
    rows within them, the same whenever the same files are read.

    The numbers come from each row's position in its file and the rows of the files before it,
    counted from the footers, so the table is neither sorted nor shuffled nor written. Pass it on
    with ``id_col="_row_id", trusted=True``. One row per file reaches the driver; up to
    100,000 files it is broadcast, beyond that AQE decides by its size.
    """
    table = spark.read.parquet(path)
    if ROW_ID in table.columns:
        raise InvalidConfigError(f"The table already has a column '{ROW_ID}'.")
    sizes = table.groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").collect()
    starts = accumulate((r["count"] for r in sizes), initial=0)
    file, start = fresh(table, "_file"), fresh(table, "_start")
    offsets = spark.createDataFrame(
        [(r["file"], at) for r, at in zip(sizes, starts)], f"{file} string, {start} bigint"
    )
    if len(sizes) <= _BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    position = fresh(table, "_position")
    placed = table.select(
        "*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(position)
    )
    return placed.join(offsets, file).select(
        *(quoted(c) for c in table.columns), (F.col(position) + F.col(start)).alias(ROW_ID)
    )


def read_table(spark: SparkSession, path: str, sheet: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension; a folder or a glob of one kind works too."""
    ext = _extension(path)
    if ext == ".csv":
        return read_csv(spark, path, **options)
    if ext == ".xlsx":
        return read_workbooks(spark, path, sheet)
    if ext in (".parquet", ".orc", ".json"):
        return require_rows(spark.read.options(**options).format(ext[1:]).load(path))
    raise UnsupportedFormatError(one_of("File type", ext, _READABLE))


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Sheet names of one workbook in order; other file types have none."""
    if _extension(path) != ".xlsx":
        return []
    rows = workbook_catalog(spark, path).orderBy("path", "sheet_index").collect()
    return list(dict.fromkeys(r["sheet_name"] for r in rows))


def write_table(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists"):
    """Write a folder of part files, without the internal row id; returns the path.

    ``single_file`` funnels the table through one task and is meant for small results only.
    """
    ext = _extension(path)
    if ext not in _WRITABLE:
        raise UnsupportedFormatError(one_of("File type to write", ext, _WRITABLE))
    out = df.drop(ROW_ID)
    if single_file:
        out = out.coalesce(1)
    if ext == ".csv":
        out.write.mode(mode).csv(str(path), header=True, escape='"')
    else:
        out.write.mode(mode).parquet(str(path))
    return path


def write_result(clean: DataFrame, audit: DataFrame, folder: str, file_type: str = "parquet"):
    """Clean rows and audit next to each other, as folders ``clean`` and ``audit``.

    Both are written to a hidden folder first and moved when they are complete, the audit before
    the clean rows: whoever finds ``clean`` finds its audit, and a run that fails leaves neither.
    """
    base = str(folder).rstrip("/")
    names = [f"audit.{file_type}", f"clean.{file_type}"]
    spark = clean.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        if files.exists(hadoop(f"{base}/{name}")):
            raise CleaningError(f"{base}/{name} is already there.")
    staging = f"{base}/_staging-{uuid.uuid4().hex}"
    try:
        for name, df in zip(names, (audit, clean)):
            write_table(df, f"{staging}/{name}")
        for name in names:
            if not files.rename(hadoop(f"{staging}/{name}"), hadoop(f"{base}/{name}")):
                raise CleaningError(f"Could not move the result to {base}/{name}.")
    finally:
        files.delete(hadoop(staging), True)
    return f"{base}/clean.{file_type}", f"{base}/audit.{file_type}"
