"""Slices, blocks and statistics of vectors, bit forms and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.generate import draw


def slices(sizes: DataFrame, keys: Sequence[str], n_slices: int, size_col: str = "n") -> DataFrame:
    """keys, slice, start, end: n positions in near-equal parts, the first n mod n_slices of them one longer."""
    n = F.col(size_col)
    each, more = F.floor(n / n_slices), n % n_slices
    k = F.col("slice")
    cut = sizes.select(*keys, n.alias(size_col), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"))
    start = k * each + F.least(k, more)
    return cut.select(*keys, "slice", start.alias("start"), (start + each + (k < more).cast("int")).alias("end"))


def block_slices(sizes: DataFrame, keys: Sequence[str], width: int, size_col: str = "n") -> DataFrame:
    """keys, slice, start, end: parts of a fixed width and a rest."""
    cut = sizes.filter(F.col(size_col) > 0).select(*keys, F.col(size_col).alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col(size_col) - 1) / width))).alias("slice"))
    return cut.select(*keys, "slice", (F.col("slice") * width).alias("start"), F.least(F.col("n"), (F.col("slice") + 1) * width).alias("end"))


def _blocks(rows: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    return rows.groupBy(*keys, F.col(block).alias("block")).agg(F.min("bit_pos").alias("start"), (F.max("bit_pos") + 1).alias("end"), F.sum("bit").alias("n_ones"))


def split_fixed(bits: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, block, start, end, n_ones: blocks of width bits."""
    return _blocks(bits.withColumn("__b", F.floor(F.col("bit_pos") / width)), keys, "__b")


def split_ones(bits: DataFrame, keys: Sequence[str], n_ones: int) -> DataFrame:
    """Blocks that end at every n_ones-th one; a last block with fewer is left out."""
    seen = F.sum("bit").over(Window.partitionBy(*keys).orderBy("bit_pos")) - F.col("bit")
    return _blocks(bits.withColumn("__b", F.floor(seen / n_ones)), keys, "__b").filter(F.col("n_ones") == n_ones)


def run_pairs(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pair, start, zeros, ones: each run of zeros with the run of ones after it."""
    w = Window.partitionBy(*keys).orderBy("bit_pos")
    head = ((F.col("bit") == 0) & (F.lag("bit", 1, 1).over(w) == 1)).cast("int")
    pair = F.sum("head").over(w)
    rows = bits.withColumn("head", head).withColumn("pair", pair)
    first = F.min("pair").over(Window.partitionBy(*keys))
    return rows.withColumn("pair", F.col("pair") - first).groupBy(*keys, "pair").agg(F.min("bit_pos").alias("start"), F.sum(1 - F.col("bit")).alias("zeros"), F.sum("bit").alias("ones"))


def pairs_of_bits(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As run_pairs, from bit strings (keys, bits): a row for each pair, and none for each bit."""
    each = bits.select(*keys, F.posexplode(F.regexp_extract_all("bits", F.lit("0*1+|0+"), F.lit(0))).alias("pair", "run"))
    n = F.length("run").cast("long")
    ones = F.length(F.replace("run", F.lit("0"), F.lit(""))).cast("long")
    start = F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select(*keys, F.col("pair").cast("long").alias("pair"), start.alias("start"), (n - ones).alias("zeros"), ones.alias("ones"))


def split_patterns(bits: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Blocks 0^i 1^j of at least that many bits."""
    return run_pairs(bits, keys).select(*keys, "start", (F.col("start") + F.col("zeros") + F.col("ones")).alias("end"), F.col("ones").alias("n_ones")).filter(F.col("end") - F.col("start") >= least)


def _cut_out(found: DataFrame, bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found with the bits of each block."""
    part = F.col("__bits").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return found.join(bits.select(*keys, F.col("bits").alias("__bits")), list(keys)).withColumn("part", part)


def bad_fixed(found: DataFrame, bits: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Blocks that are not as long as they say, or as width says unless they are the last."""
    size = F.col("end") - F.col("start")
    return _cut_out(found, bits, keys).filter((F.length("part") != size) | ((size != width) & (F.col("end") != F.length("__bits"))))


def bad_ones(found: DataFrame, bits: DataFrame, keys: Sequence[str], n_ones: int) -> DataFrame:
    """Blocks that are not as long as they say, or hold other than n_ones ones."""
    ones = F.length(F.replace("part", F.lit("0"), F.lit("")))
    return _cut_out(found, bits, keys).filter((F.length("part") != F.col("end") - F.col("start")) | (ones != n_ones))


def bad_patterns(found: DataFrame, bits: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Blocks that are not zeros and then ones, or shorter than least."""
    return _cut_out(found, bits, keys).filter((F.length("part") != F.col("end") - F.col("start")) | ~F.col("part").rlike("^0*1*$") | (F.length("part") < least))


def run_histogram(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bit, length, n: how many runs of a bit have a length."""
    pairs = run_pairs(bits, keys)
    long = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("zeros").alias("length")), F.struct(F.lit(1).alias("bit"), F.col("ones").alias("length")))).alias("r"))
    return long.filter("r.length > 0").groupBy(*keys, "r.bit", "r.length").agg(F.count(F.lit(1)).alias("n"))


def symbols(texts: DataFrame, keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """keys, symbol for every code point of every text."""
    return texts.select(*keys, F.explode_outer(F.split(text_col, "")).alias("symbol")).filter("symbol <> ''")


def char_frequencies(texts: DataFrame, keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    return symbols(texts, keys, text_col).groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"))


def char_table(texts: DataFrame, keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """keys, symbol, n, share: with the share of all symbols."""
    n = char_frequencies(texts, keys, text_col)
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    both = n.join(total, list(keys)) if keys else n.crossJoin(F.broadcast(total))
    return both.select(*keys, "symbol", "n", (F.col("n") / F.col("total")).alias("share"))


def alphabet(texts: DataFrame, keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """keys, symbol, code: the distinct symbols with dense codes in code point order."""
    n = char_frequencies(texts, keys, text_col)
    return n.select(*keys, "symbol", F.row_number().over(Window.partitionBy(*keys).orderBy("symbol")).alias("code"))


def mutations(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, char1, char2, is_mut, n: symbols at equal places of two strings, as far as the shorter one goes."""
    both = pairs.select(*keys, F.explode(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))).alias("z")).select(*keys, F.col("z.x").alias("char1"), F.col("z.y").alias("char2"))
    seen = both.filter("char1 <> '' and char2 <> ''")
    return seen.groupBy(*keys, "char1", "char2").agg(F.count(F.lit(1)).alias("n")).select(*keys, "char1", "char2", (F.col("char1") != F.col("char2")).cast("int").alias("is_mut"), "n")


def repeat_bitmap(texts: DataFrame, keys: Sequence[str], width: int, text_col: str = "text") -> DataFrame:
    """keys, block, n_same: how many code points of each block of width equal those of block 0."""
    cut = texts.filter(F.length(text_col) > 0).select(*keys, F.col(text_col).alias("__t"), F.explode(F.sequence(F.lit(0), F.floor((F.length(text_col) - 1) / width))).alias("block"))
    part = F.split(F.col("__t").substr((F.col("block") * width + 1).cast("int"), F.lit(width)), "")
    first = F.split(F.col("__t").substr(F.lit(1), F.lit(width)), "")
    pairs = cut.select(*keys, "block", F.arrays_zip(part.alias("x"), first.alias("y")).alias("z"))
    same = F.size(F.filter("z", lambda z: (z["x"] == z["y"]) & (z["x"] != "")))
    return pairs.select(*keys, "block", same.cast("long").alias("n_same"))


def block_sample(texts: DataFrame, keys: Sequence[str], width: int, n: int, seed: int = 0, text_col: str = "text") -> DataFrame:
    """keys, sample, start, block: n random blocks of each text, equal for equal seeds."""
    each = texts.filter(F.length(text_col) >= width).select(*keys, F.col(text_col).alias("__t"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    start = draw(seed, F.col("sample"), *map(F.col, keys)) % (F.length("__t") - width + 1)
    return each.withColumn("start", start).select(*keys, "sample", "start", F.col("__t").substr((F.col("start") + 1).cast("int"), F.lit(width)).alias("block"))
