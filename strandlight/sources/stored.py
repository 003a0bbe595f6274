"""Vectors, trees and indexes as Parquet in a shared folder: write once, read often."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="stored-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path as a whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def store(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """df written to path, in place of what is there, and read again. by: columns that the files' rows are sorted by,
    so that lookups by them skip row groups."""
    (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
    """The table at path; it is built and stored first if it is not there, or was not written to its end."""
    return spark.read.parquet(path) if is_there(spark, path) else store(build(), path, by)


def write_lines(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """The text form of a table: a line for each row, its columns joined by sep. Gives the lines as read again."""
    joined = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    df.select(joined.alias("value")).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path)
