"""Cutting lineage so that loops and non-repeatable results survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from kindred.errors import CleaningError


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise CleaningError(
                    "Set spark.checkpoint.dir to a folder all executors share."
                )
            folder = tempfile.mkdtemp(prefix="kindred-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def drop_intermediate(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder.

    Call it when all results have been written: DataFrames that read intermediate results are of no
    use afterwards. Folders of other sessions are not touched.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
