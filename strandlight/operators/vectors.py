"""Operators on the vector of matching statistics: keys, pos, ms.

With ms[-1] = 1, the bit form writes ms[i] - ms[i-1] + 1 zeros and a one for each
position, and pads a zero if the last value is 0, so that it has two bits a position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: str = "pos") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def zeros_before(keys: Sequence[str]) -> Column:
    return F.col("ms") - F.lag("ms", 1, 1).over(_by(keys)) + 1


def encode(ms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bits: the bit form as a string of 0 and 1."""
    codes = ms.withColumn("code", F.concat(F.repeat(F.lit("0"), zeros_before(keys)), F.lit("1")))
    whole = codes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "code", "ms"))).alias("x"))
    pad = F.when(F.element_at("x", -1)["ms"] == 0, F.lit("0")).otherwise(F.lit(""))
    return whole.select(*keys, F.concat(F.array_join(F.transform("x", lambda x: x["code"]), ""), pad).alias("bits"))


def encode_arrays(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bits from keys, ms (array): the same form, without a row for each position."""
    code = lambda x, i: F.concat(F.repeat(F.lit("0"), x + 1 - F.when(i == 0, 1).otherwise(F.get("ms", i - 1))), F.lit("1"))
    pad = F.when(F.element_at("ms", -1) == 0, F.lit("0")).otherwise(F.lit(""))
    return vectors.filter(F.size("ms") > 0).select(*keys, F.concat(F.array_join(F.transform("ms", code), ""), pad).alias("bits"))


def bit_rows(bits: DataFrame, keys: Sequence[str], bits_col: str = "bits") -> DataFrame:
    """keys, bit_pos, bit."""
    return bits.select(*keys, F.posexplode_outer(F.split(bits_col, "")).alias("bit_pos", "bit")).filter("bit in ('0', '1')").select(*keys, F.col("bit_pos").cast("long").alias("bit_pos"), F.col("bit").cast("int").alias("bit"))


def decode(bits: DataFrame, keys: Sequence[str], bits_col: str = "bits") -> DataFrame:
    """keys, pos, ms from the bit form: the place of the pos-th one, less twice pos."""
    ones = bit_rows(bits, keys, bits_col).filter("bit = 1").withColumn("pos", F.row_number().over(_by(keys, "bit_pos")).cast("long") - 1)
    return ones.select(*keys, "pos", (F.col("bit_pos") - 2 * F.col("pos")).cast("int").alias("ms"))


def runs(ms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, runs: 1 where the value is one less than before; the first is 0."""
    return ms.select(*keys, "pos", F.coalesce((F.col("ms") == F.lag("ms").over(_by(keys)) - 1).cast("int"), F.lit(0)).alias("runs"))


def runs_with_frequency(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, runs_freq: 1 where besides the match occurs as often as the one before."""
    w = _by(keys)
    same = (F.col("ms") == F.lag("ms").over(w) - 1) & (F.col("freq") == F.lag("freq").over(w))
    return freq.select(*keys, "pos", F.coalesce(same.cast("int"), F.lit(0)).alias("runs_freq"))


def average(ms: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ms.groupBy(*keys).agg(F.avg("ms").alias("avg_ms"))


def composition(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_bits, n_zeros, n_ones, counted in the bits themselves."""
    size, ones = F.length("bits").cast("long"), F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("long")
    return bits.select(*keys, size.alias("n_bits"), (size - ones).alias("n_zeros"), ones.alias("n_ones"))


def extremes(ms: DataFrame, keys: Sequence[str], bound: int) -> DataFrame:
    """keys, max_ms, some_at_most (whether some value is bound at most)."""
    return ms.groupBy(*keys).agg(F.max("ms").alias("max_ms"), F.max(F.col("ms") <= bound).alias("some_at_most"))


def check(ms: DataFrame, bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the violations of each invariant: a value falls by one at most, none is negative, the bit form has
    two bits a position, and as many ones as positions."""
    drops = ms.withColumn("zeros", zeros_before(keys)).groupBy(*keys).agg(F.count_if(F.col("zeros") < 0).alias("falls"), F.count_if(F.col("ms") < 0).alias("negative"), F.count(F.lit(1)).alias("n"))
    sized = bits.select(*keys, F.length("bits").alias("n_bits"), F.length(F.replace("bits", F.lit("0"), F.lit(""))).alias("n_ones"))
    return drops.join(sized, list(keys), "left").select(*keys, "falls", "negative", (F.coalesce("n_bits", F.lit(0)) != 2 * F.col("n")).cast("int").alias("bad_length"), (F.coalesce("n_ones", F.lit(0)) != F.col("n")).cast("int").alias("bad_ones"))


def stats(bits: DataFrame, keys: Sequence[str], start: int = 0, length: int = 0) -> DataFrame:
    """keys, size, zeros, ones of bits [start, start + length); length 0 is to the end."""
    part = slice_bits(bits, keys, start, length)
    size, ones = F.length("bits").cast("long"), F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("long")
    return part.select(*keys, size.alias("size"), (size - ones).alias("zeros"), ones.alias("ones"))


def slice_bits(bits: DataFrame, keys: Sequence[str], start: int = 0, length: int = 0) -> DataFrame:
    n = F.lit(length) if length else F.length("bits")
    return bits.select(*keys, F.col("bits").substr(F.lit(start + 1), n).alias("bits"))


def printed(ms: DataFrame, keys: Sequence[str], column: str = "ms", start: int = 0, length: int = 0) -> DataFrame:
    """keys, line: the values of positions [start, start + length), in order, with spaces between; length 0 is to the end."""
    inside = (F.col("pos") >= start) & (F.col("pos") < start + length) if length else F.col("pos") >= start
    rows = ms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", F.col(column).alias("v"))))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda x: x["v"].cast("string")), " ").alias("line"))


def value_at(ms: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points (keys, pos) with ms; a position outside the vector has none. The rows of positions are never broadcast:
    the planner takes them for as few as the compressed texts that they come from."""
    return points.join(ms.hint("merge"), [*keys, "pos"], "left")


def full_table(freq: DataFrame, queries: DataFrame, keys: Sequence[str], query_col: str = "text") -> DataFrame:
    """keys, pos, symbol, ms, n_zeros, bits, runs, matched, freq, runs_freq."""
    w = _by(keys)
    zeros = zeros_before(keys)
    rows = freq.withColumns({"n_zeros": zeros, "runs": F.coalesce((F.col("ms") == F.lag("ms").over(w) - 1).cast("int"), F.lit(0)), "runs_freq": F.coalesce(((F.col("ms") == F.lag("ms").over(w) - 1) & (F.col("freq") == F.lag("freq").over(w))).cast("int"), F.lit(0))})
    both = rows.join(queries.select(*keys, F.col(query_col).alias("__t")), list(keys))
    at = (F.col("pos") + 1).cast("int")
    return both.select(*keys, "pos", F.col("__t").substr(at, F.lit(1)).alias("symbol"), "ms", F.col("n_zeros").cast("int").alias("n_zeros"), F.concat(F.repeat(F.lit("0"), "n_zeros"), F.lit("1")).alias("bits"), "runs", F.col("__t").substr(at, F.col("ms")).alias("matched"), "freq", "runs_freq")
