"""Benchmark passages inside documents, by SimHash windows and exact verification.

A window has as many words as some benchmark item. Windows that share no shingle with
any item have similarity 0 with all of them, so fingerprints are made of the others
only. RADIUS + 1 blocks of a fingerprint index it: two fingerprints within RADIUS bits
agree in a block at least. Pairs within the radius are verified by the weighted Jaccard
similarity of their shingle sets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, fresh, row_key, table

WIDTH = 5
MIN_SIMILARITY = 0.8
#: Two sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9;
#: one such pair in several thousand is beyond 20.
RADIUS = 20
BITS = 64
#: Shingles whose windows are handled together; a longer text is dealt out in segments of so many.
SEGMENT = 4096


def _words(text: Column) -> Column:
    """Words in lower case without punctuation."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(F.length(flat) > 0, F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(words: str, width: int) -> Column:
    """The hash of each run of width words; of all words if there are fewer; none without words."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    few = F.array(*(F.get(words, F.lit(k)) for k in range(width - 1)))
    return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(F.to_json(few)))).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(hashes: str) -> Column:
    """Bit b is set if most hashes have it set."""
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if(aggregate({hashes}, 0, (s, x) -> s + if(getbit(x, b) = 1, 1, -1)) > 0, shiftleft(1L, b), 0L))")


def _bounds(radius: int) -> list[tuple[int, int, int]]:
    """Number, first and last bit (exclusive) of each of radius + 1 blocks."""
    at = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(k, a, z) for k, (a, z) in enumerate(zip(at, at[1:], strict=False))]


def _blocks(fingerprint: str, radius: int) -> Column:
    """Number and bits of each block."""
    return F.array(*(F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("bits")) for k, a, z in _bounds(radius)))


def _agrees_before(apart: Column, no: Column, radius: int) -> Column:
    """Whether two fingerprints, given by the bits in which they differ, agree in a block before block no."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    same = [(no > k) & (apart.bitwiseAND(F.lit(signed((1 << z) - (1 << a)))) == 0) for k, a, z in _bounds(radius)]
    return reduce(lambda x, y: x | y, same)


def _items(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, float]:
    """(item, item_id, n_words, sh: distinct shingles with weights, total, positions, fp) of each distinct item, and
    the weight of a shingle that is in no item."""
    raw = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    words = raw.select("item_id", F.md5(F.coalesce("text", F.lit(""))).alias("item"), _words(F.coalesce("text", F.lit(""))).alias("words"))
    words = cut(words.select("item_id", "item", F.size("words").cast("int").alias("n_words"), _hashes("words", width).alias("hashes")).filter("n_words > 0"))
    n = words.count()
    each = words.select("item_id", "item", F.explode_outer(F.array_distinct("hashes")).alias("h"))
    df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.round(F.log(1 + F.lit(float(n)) / F.col("df")), 9)
    weighted = each.join(df, "h").select("item_id", "item", "h", weight.alias("wt")).groupBy("item_id", "item").agg(F.array_sort(F.collect_list(F.struct("h", "wt"))).alias("sh"), F.sum("wt").alias("total"))
    same = (F.col("w.item") == F.col("s.item")) & F.col("w.item_id").eqNullSafe(F.col("s.item_id"))
    items = words.alias("w").join(weighted.alias("s"), same).select("w.item_id", "w.item", "n_words", "hashes", "sh", "total", _fingerprint("hashes").alias("fp"))
    return cut(items), round(math.log(1 + n), 9)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item of which the document has a window: k1, k2, doc_id, item_id,
    start_word, n_words, hamming, similarity (of the most similar window, the first of equals).

    Similarity is the weight of the shared shingles over the weight of all shingles of
    window and item; a shingle in few items weighs more. Defined cases: null and empty
    texts, on either side, match nothing; with fewer words than width, the whole sequence
    is one shingle; a document shorter than an item is one window; repeated documents
    (same id and text) are one, repeated items (same id and text) too; an empty table on
    either side gives an empty table. Item tables are broadcast up to BROADCAST_ROWS rows.
    """
    items, default = _items(benchmark, item_id_col, item_text_col, width)
    seeds = items.select("n_words", F.posexplode("hashes").alias("o", "h")).groupBy("h").agg(F.collect_set(F.struct("n_words", "o")).alias("places"))
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    hashed = keyed.select("k1", "k2", _words(F.col("text")).alias("words")).select("k1", "k2", _hashes("words", width).alias("hashes"))
    # the outer form, since for the inner one the optimizer repeats the hashing in a filter on the array's size
    spots = hashed.select("k1", "k2", F.size("hashes").alias("n"), F.posexplode_outer("hashes").alias("p", "h")).join(broadcast_if_small(cut(seeds)), "h")
    place = spots.select("k1", "k2", "n", "p", F.explode("places").alias("place"))
    size = F.greatest(F.lit(1), F.col("place.n_words") - width + 1)  # in shingles
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("place.o"), F.col("n") - size))
    windows = place.select("k1", "k2", start.alias("start"), F.col("place.n_words").alias("n_words")).distinct()
    longest = items.agg(F.max("n_words")).first()[0] or 0
    part = F.floor(F.col("start") / SEGMENT).cast("int")
    by_part = cut(windows.groupBy("k1", "k2", part.alias("part")).agg(F.collect_list(F.struct("start", "n_words")).alias("windows")))
    hit = cut(by_part.select("k1", "k2").distinct())
    texts = keyed.select("k1", "k2", "doc_id", "text").join(broadcast_if_small(hit), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    with_hashes = texts.select("k1", "k2", "doc_id", _words(F.col("text")).alias("words")).select("k1", "k2", "doc_id", _hashes("words", width).alias("hashes"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / SEGMENT).cast("int")), lambda i: F.struct(i.alias("part"), F.slice("hashes", i * SEGMENT + 1, SEGMENT + longest).alias("hashes")))
    pieces = with_hashes.select("k1", "k2", "doc_id", F.explode_outer(F.when(F.size("hashes") > 0, parts)).alias("x")).filter("x is not null").select("k1", "k2", "doc_id", "x.part", "x.hashes")
    cuts = F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n_words"].alias("n_words"), F.slice("hashes", x["start"] % SEGMENT + 1, F.greatest(F.lit(1), x["n_words"] - width + 1)).alias("sh")))
    one = pieces.join(broadcast_if_small(by_part), ["k1", "k2", "part"]).select("k1", "k2", "doc_id", F.explode(cuts).alias("x")).select("k1", "k2", "doc_id", "x.start", "x.n_words", "x.sh")
    prints = cut(one.withColumn("fp", _fingerprint("sh")).withColumn("sh", F.array_distinct("sh")))
    index = items.select("item", "item_id", F.col("n_words").alias("i_words"), F.col("fp").alias("i_fp"), F.explode(_blocks("fp", radius)).alias("block"))
    index = index.select("item", "item_id", "i_words", "i_fp", F.col("block.no").alias("i_no"), F.col("block.bits").alias("i_bits"))
    probes = prints.select("k1", "k2", "start", "n_words", "fp", F.explode(_blocks("fp", radius)).alias("block"))
    apart = F.col("fp").bitwiseXOR(F.col("i_fp"))
    far = F.bit_count(apart)
    # a pair that agrees in several blocks is met in the first of them
    earlier = _agrees_before(apart, F.col("i_no"), radius)
    met = probes.join(broadcast_if_small(cut(index)), (F.col("n_words") == F.col("i_words")) & (F.col("block.no") == F.col("i_no")) & (F.col("block.bits") == F.col("i_bits")) & (far <= radius) & ~earlier)
    pairs = met.select("k1", "k2", "start", "n_words", "item", "item_id", far.alias("hamming"))
    sized = items.select(F.col("item").alias("v_item"), F.col("item_id").alias("v_id"), F.col("sh").alias("item_sh"), "total")
    checked = pairs.join(prints.select("k1", "k2", "doc_id", "start", "n_words", "sh"), ["k1", "k2", "start", "n_words"]).join(broadcast_if_small(sized), (F.col("item") == F.col("v_item")) & F.col("item_id").eqNullSafe(F.col("v_id")))
    shared = F.filter("item_sh", lambda x: F.array_contains("sh", x["h"]))
    scored = checked.withColumn("shared", shared).withColumn("both", F.aggregate("shared", F.lit(0.0), lambda s, x: s + x["wt"]))
    similarity = F.round(F.col("both") / (F.col("total") + (F.size("sh") - F.size("shared")) * F.lit(default)), 6)
    good = scored.withColumn("similarity", similarity).filter(F.col("similarity") >= min_similarity)
    best = good.groupBy("k1", "k2", "doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming")).alias("b"))
    return best.select("k1", "k2", "doc_id", "item_id", F.col("b.start").alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.hamming").alias("hamming"), (-F.col("b.s")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """docs without those that hold a benchmark item, with docs' columns and repeated rows."""
    n1, n2 = fresh(docs, "k1", "k2")
    bad = cut(contaminated(docs, benchmark, id_col, text_col, **how).select(F.col("k1").alias(n1), F.col("k2").alias(n2)).distinct())
    k1, k2 = row_key(id_col, text_col)
    return docs.join(broadcast_if_small(bad), (k1 == F.col(n1)) & (k2 == F.col(n2)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")
