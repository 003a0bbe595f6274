"""Strings from digests: equal for equal seeds, whatever the partitions, and in any engine that has MD5."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A number below 2^32 from the parts, written with colons between them."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _pick(symbols: str, index: Column) -> Column:
    return F.substr(F.lit(symbols), index.cast("int") + 1, F.lit(1))


def random_text(spark: SparkSession, n: int, symbols: str = "abcde", seed: int = 0, weights: Sequence[int] | None = None) -> DataFrame:
    """pos, symbol: n symbols, each as likely as its weight says; without weights all the same."""
    weights = list(weights or [1] * len(symbols))
    if len(weights) != len(symbols) or min(weights) < 0 or not sum(weights):
        raise ValueError("a weight of 0 or more for each symbol, and not all 0")
    ends = F.array(*map(F.lit, accumulate(weights)))
    u = draw(seed, F.col("id")) % sum(weights)
    return spark.range(n).select(F.col("id").alias("pos"), u.alias("u")).select("pos", _pick(symbols, F.size(F.filter(ends, lambda e: e <= F.col("u")))).alias("symbol"))


def _other(symbols: str, by: Column) -> Column:
    """Another symbol than the one that stands there, as by says."""
    at = F.expr(f"instr('{symbols}', symbol)") - 1
    return _pick(symbols, (at + 1 + by % (len(symbols) - 1)) % len(symbols))


def mutate(text: DataFrame, k: int, symbols: str = "abcde", seed: int = 0) -> DataFrame:
    """text (pos, symbol) with k places changed to another symbol; places are the k least by a digest."""
    least = text.select("pos", draw(seed, "at", F.col("pos")).alias("h")).orderBy("h", "pos").limit(k).select(F.col("pos").alias("__p"))
    marked = text.join(least, F.col("pos") == F.col("__p"), "left")
    return marked.select("pos", F.when(F.col("__p").isNotNull(), _other(symbols, draw(seed, "to", F.col("pos")))).otherwise(F.col("symbol")).alias("symbol"))


def repetitive(spark: SparkSession, width: int, copies: int, mutations: int, symbols: str = "abcde", seed: int = 0) -> DataFrame:
    """pos, symbol: a random block and copies of it, each with its own changed places."""
    block = random_text(spark, width, symbols, seed)
    many = block.crossJoin(spark.range(copies).select(F.col("id").alias("copy")))
    rank = F.row_number().over(Window.partitionBy("copy").orderBy(draw(seed, F.col("copy"), "at", F.col("pos")), "pos"))
    drawn = many.withColumn("__r", rank)
    symbol = F.when((F.col("copy") > 0) & (F.col("__r") <= mutations), _other(symbols, draw(seed, F.col("copy"), "to", F.col("pos")))).otherwise(F.col("symbol"))
    return drawn.select((F.col("copy") * width + F.col("pos")).alias("pos"), symbol.alias("symbol"))


def joined(text: DataFrame) -> DataFrame:
    """One row: the text of (pos, symbol)."""
    rows = text.agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda x: x["symbol"]), "").alias("text"))


def families(spark: SparkSession, n: int = 300, lengths: Sequence[int] = (50, 150), blocks: int = 5, repeats: int = 10, similar: int = 15, symbols: str = "abcde", seed: int = 0) -> DataFrame:
    """pair_id, s, t: texts that are random (rnd) or repetitive (rep), each with queries that are random (dis) or a
    changed prefix of the text (sim), of every length."""
    out = None
    for kind, s in (("rnd", random_text(spark, n, symbols, seed)), ("rep", repetitive(spark, n // blocks, blocks, repeats, symbols, seed))):
        text = joined(s).withColumnRenamed("text", "s")
        for m in lengths:
            for way, t in (("dis", random_text(spark, m, symbols, seed + m)), ("sim", mutate(s.filter(F.col("pos") < m), similar, symbols, seed + m))):
                row = text.crossJoin(joined(t).withColumnRenamed("text", "t")).select(F.lit(f"{kind}_{n}s_{way}_{m}t_{symbols}").alias("pair_id"), "s", "t")
                out = row if out is None else out.unionByName(row)
    return out
