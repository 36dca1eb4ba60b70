"""Shared helpers: words, written tables, text as bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.plans.cut import shared_folder
from kindred.plans.ids import quoted

# a word is a run of anything but ASCII white space; bytes.split() cuts at the same six bytes
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def boxed(docs: DataFrame, **needed: Column) -> DataFrame:
    """The whole row as one column ``row``, next to the columns an operator works on, so that no
    name of the table can clash with one of the operator's."""
    return docs.select(
        F.struct(*(col(c) for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in needed.items())
    )


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of ``boxed`` as they were, but for ``changed`` columns."""
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def new_folder(spark: SparkSession) -> str:
    """The name of a new table in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that was ``written`` and that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the copy.

    Like a checkpoint, but compressed and column by column, so that later steps read only what
    they need. Lost executors cost nothing: the files lie in the shared folder.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
