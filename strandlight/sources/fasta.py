"""FASTA text as rows: a line that begins with > heads a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, backwards: bool = False) -> DataFrame:
    """text of each file under path, whole; backwards by code points."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return rows.select(F.reverse("text").alias("text")) if backwards else rows


def records(lines: DataFrame, keys: Sequence[str], line_no: str, line: str) -> DataFrame:
    """keys, record (from 1), header, sequence. Lines before the first header belong to no record."""
    head = F.col(line).startswith(">")
    numbered = lines.withColumn("record", F.sum(head.cast("long")).over(Window.partitionBy(*keys).orderBy(line_no))).filter("record > 0")
    parts = numbered.groupBy(*keys, "record").agg(F.max(F.when(head, F.substr(F.col(line), F.lit(2)))).alias("header"), F.array_sort(F.collect_list(F.when(~head, F.struct(F.col(line_no).alias("n"), F.col(line).alias("l"))))).alias("x"))
    return parts.select(*keys, "record", "header", F.array_join(F.transform("x", lambda x: x["l"]), "").alias("sequence"))


def clean(records_: DataFrame) -> DataFrame:
    """Sequences without the unknown base N."""
    return records_.withColumn("sequence", F.replace("sequence", F.lit("N"), F.lit("")))
