"""Bits that the run-length, gap and recoding codes of a bit form take.

Runs are pairs of zeros and the ones after them. A first run of ones has no zeros
before it, so zeros are coded one higher; a last run of zeros without ones is not coded,
since the length is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions.codes import delta_length, nibble_length, project


def _total(pairs: DataFrame, keys: Sequence[str], cost: Column) -> DataFrame:
    return pairs.filter("ones > 0").groupBy(*keys).agg(F.sum(cost).cast("long").alias("n_bits"))


def rle_bits(pairs: DataFrame, keys: Sequence[str], length: Callable[[Column], Column] = delta_length) -> DataFrame:
    """keys, n_bits with a gap and a run length a pair."""
    return _total(pairs, keys, length(F.col("zeros") + 1) + length(F.col("ones")))


def gap_bits(bits: DataFrame, keys: Sequence[str], length: Callable[[Column], Column] = delta_length) -> DataFrame:
    """keys, n_bits with the distance from each one to the one before."""
    ones = bits.filter("bit = 1")
    gap = F.col("bit_pos") - F.lag("bit_pos", 1, -1).over(Window.partitionBy(*keys).orderBy("bit_pos"))
    return ones.withColumn("__g", gap).groupBy(*keys).agg(F.sum(length(F.col("__g"))).cast("long").alias("n_bits"))


def recoded_bits(pairs: DataFrame, keys: Sequence[str], threshold: int = 0) -> DataFrame:
    """keys, n_bits with runs of ones coded by how near they are to the zeros before."""
    return _total(pairs, keys, delta_length(F.col("zeros") + 1) + delta_length(project(F.col("zeros"), F.col("ones"), 1, threshold)))


def block_bits(bits: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, block, plain, rle: the bits of each block as they are, and as runs that begin anew in it."""
    w = Window.partitionBy(*keys, "block").orderBy("bit_pos")
    rows = bits.withColumn("block", F.floor(F.col("bit_pos") / width))
    rows = rows.withColumn("__h", F.coalesce((F.col("bit") != F.lag("bit").over(w)).cast("int"), F.lit(1))).withColumn("__r", F.sum("__h").over(w))
    runs = rows.groupBy(*keys, "block", "__r").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys, "block").agg(F.sum("n").alias("plain"), F.sum(delta_length(F.col("n"))).cast("long").alias("rle"))


def value_runs(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, run, start, n, value: runs of equal values; all of them."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("__h", F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("__h").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.min(column).alias("value"))


def nibble_bits(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rle_bits(pairs, keys, nibble_length)
