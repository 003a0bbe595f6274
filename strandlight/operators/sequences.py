"""Operators on an integer sequence (i, c) and batches of queries (q, ...), on permutations, points and edges.

Ranges are half open. A range join is an equality on blocks of positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def ranks(seq: DataFrame) -> DataFrame:
    """i, c, rank: how many equal symbols come before; the inverse of select."""
    return seq.select("i", "c", (F.row_number().over(Window.partitionBy("c").orderBy("i")) - 1).cast("long").alias("rank"))


def rank_at(seq: DataFrame, queries: DataFrame, at: str = "i", out: str = "rank") -> DataFrame:
    """queries (q, at, c) with the number of c before position at: queries take their place among the symbol's positions."""
    marks = seq.select("c", F.col("i").alias("__at"), F.lit(1).alias("__hit"), F.lit(None).cast("long").alias("q"))
    asks = queries.select("c", F.col(at).alias("__at"), F.lit(0).alias("__hit"), F.col("q").cast("long").alias("q"))
    w = Window.partitionBy("c").orderBy("__at", "__hit").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(asks).withColumn(out, F.sum("__hit").over(w)).filter("q is not null").select("q", F.col(out).cast("long").alias(out))
    return queries.join(counted, "q")


def select_kth(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (q, c, k) with pos, where the k-th c (from 1) stands; null if there are fewer."""
    where = ranks(seq).select("c", (F.col("rank") + 1).alias("k"), F.col("i").alias("pos"))
    return queries.join(where, ["c", "k"], "left")


def select_after(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (q, i, c, k) with pos, where the k-th c at or after i stands."""
    moved = rank_at(seq, queries, "i", "__r").withColumns({"__k": F.col("k"), "k": F.col("k") + F.col("__r")})
    found = select_kth(seq, moved)
    return found.select(*(F.col("__k").alias("k") if c == "k" else F.col(c) for c in queries.columns), "pos")


def in_ranges(seq: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each range (q, lb, rb) with the rows i, c that lie in it."""
    cut = ranges.filter("rb > lb").withColumn("__b", F.explode(F.sequence(F.floor(F.col("lb") / block), F.floor((F.col("rb") - 1) / block))))
    return seq.withColumn("__b", F.floor(F.col("i") / block)).withColumnRenamed("c", "sym").join(cut, "__b").filter("i >= lb and i < rb").drop("__b")


def interval_symbols(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """q, sym, n, rank_lb, rank_rb: the distinct symbols of each range with their ranks at both ends."""
    ranked = ranks(seq)
    met = in_ranges(ranked, ranges)
    return met.groupBy("q", "sym").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank_lb"), (F.max("rank") + 1).alias("rank_rb"))


def lex_count(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """q, smaller, greater, equal: the range's symbols against c."""
    met = in_ranges(seq, ranges)
    found = met.groupBy("q").agg(F.count_if(F.col("sym") < F.col("c")).alias("smaller"), F.count_if(F.col("sym") > F.col("c")).alias("greater"), F.count_if(F.col("sym") == F.col("c")).alias("equal"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ranges.select("q").join(found, "q", "left").select("q", zero("smaller"), zero("greater"), zero("equal"))


def quantile(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """q, value, n: the k-th smallest symbol (k from 0) of each range, and how often it stands there."""
    n = in_ranges(seq, ranges).groupBy("q", "k", "sym").agg(F.count(F.lit(1)).alias("n"))
    upto = n.withColumn("__u", F.sum("n").over(Window.partitionBy("q").orderBy("sym")))
    return upto.filter((F.col("k") < F.col("__u")) & (F.col("k") >= F.col("__u") - F.col("n"))).select("q", F.col("sym").alias("value"), "n")


def intersect(seq: DataFrame, ranges: DataFrame, least: int) -> DataFrame:
    """grp, sym, n_ranges: symbols in at least that many ranges of a group."""
    return in_ranges(seq, ranges).groupBy("grp", "sym").agg(F.count_distinct("q").alias("n_ranges")).filter(F.col("n_ranges") >= least)


def pred_succ(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """q, pred (greatest symbol up to c), succ (least from c on) of each range."""
    met = in_ranges(seq, ranges)
    found = met.groupBy("q").agg(F.max(F.when(F.col("sym") <= F.col("c"), F.col("sym"))).alias("pred"), F.min(F.when(F.col("sym") >= F.col("c"), F.col("sym"))).alias("succ"))
    return ranges.select("q").join(found, "q", "left")


def unique_values(seq: DataFrame, ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """q, sym: the distinct symbols of each range in [low, high]."""
    return in_ranges(seq, ranges).filter((F.col("sym") >= low) & (F.col("sym") <= high)).select("q", "sym").distinct()


def count_2d(seq: DataFrame, ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    found = in_ranges(seq, ranges).filter((F.col("sym") >= low) & (F.col("sym") <= high)).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return ranges.select("q").join(found, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def range_extremes(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """q, min_pos, min_value, max_pos, max_value; the leftmost of equals."""
    met = in_ranges(seq, ranges)
    found = met.groupBy("q").agg(F.min(F.struct("sym", "i")).alias("a"), F.max(F.struct(F.col("sym"), (-F.col("i")).alias("neg"))).alias("z"))
    return ranges.select("q").join(found, "q", "left").select("q", F.col("a.i").alias("min_pos"), F.col("a.sym").alias("min_value"), (-F.col("z.neg")).alias("max_pos"), F.col("z.sym").alias("max_value"))


def inverse_permutation(perm: DataFrame) -> DataFrame:
    """(i, p) to (i, inv)."""
    return perm.select(F.col("p").alias("i"), F.col("i").alias("inv"))


def smaller_values(rows: DataFrame, keys: Sequence[str], i: str, v: str) -> DataFrame:
    """keys, i, psv, nsv: the nearest places before and after with a smaller value; -1 and null beside none.

    A sequence (keys) is one row, which a stack goes through once.
    """
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(i).cast("long").alias("i"), F.col(v).alias("v")))).alias("x"))
    schema = ", ".join([*(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys), "x array<struct<i:bigint,psv:bigint,nsv:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int64()), ("psv", pa.int64()), ("nsv", pa.int64())]))
        for b in batches:
            out = []
            for row in b.column("x").to_pylist():
                found, stack = [], []
                for x in row:
                    while stack and stack[-1][0] > x["v"]:
                        stack.pop()[1]["nsv"] = x["i"]
                    # of equal values the nearest smaller one before is that of the first of them
                    before = stack[-1][1] if stack else None
                    psv = -1 if before is None else before["i"] if stack[-1][0] < x["v"] else before["psv"]
                    found.append({"i": x["i"], "psv": psv, "nsv": None})
                    stack.append((x["v"], found[-1]))
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, kind)], names=[*keys, "x"])

    flat = lists.mapInArrow(run, schema).select(*keys, F.explode("x").alias("x"))
    return flat.select(*keys, F.col("x.i").alias(i), "x.psv", "x.nsv")


def match_parentheses(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, i, mate of balanced parentheses (keys, i, open): on one level of depth, opening and closing ones take turns."""
    depth = F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(Window.partitionBy(*keys).orderBy("i"))
    leveled = rows.withColumn("__d", depth + F.when(F.col("open"), 0).otherwise(1))
    w = Window.partitionBy(*keys, "__d").orderBy("i")
    return leveled.select(*keys, "i", F.when(F.col("open"), F.lead("i").over(w)).otherwise(F.lag("i").over(w)).alias("mate"), F.col("__d").alias("level"))


def neighbours(edges: DataFrame, of: str, to: str) -> DataFrame:
    """of, n, least, most of the distinct neighbours."""
    return edges.select(of, to).distinct().groupBy(of).agg(F.count(F.lit(1)).alias("n"), F.min(to).alias("least"), F.max(to).alias("most"))


def in_rectangles(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (x, y, w, id) in each box (q, x0, x1, y0, y1), ends included; boxes are dealt by strips of x."""
    width = 256
    cut = boxes.withColumn("__s", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))))
    return points.withColumn("__s", F.floor(F.col("x") / width)).join(cut, "__s").filter("x between x0 and x1 and y between y0 and y1").drop("__s")


def heaviest(points: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """The k heaviest points of each box; of equal weights those with the least id."""
    w = Window.partitionBy("q").orderBy(F.desc("w"), "id")
    return in_rectangles(points, boxes).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "x", "y", "w", "id")
