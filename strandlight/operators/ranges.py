"""Batches of range queries over a vector: ranges (keys, range_id, from_idx, to_idx), half open.

Ranges are clamped to the vector; an empty or inverted one gives no sum and no maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: the planner's estimates follow the compressed vectors, not their positions."""
    return left.join(right.hint("merge"), list(on), how)


def _pieces(ranges: DataFrame, block: int) -> DataFrame:
    """Each range once for every block of positions that it meets, so that a range join is an equality on the block."""
    from_ = F.greatest(F.col("from_idx"), F.lit(0))
    return ranges.filter(F.col("to_idx") > from_).select("*", F.explode(F.sequence(F.floor(from_ / block), F.floor((F.col("to_idx") - 1) / block))).alias("block"))


def _within(ms: DataFrame, ranges: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    left = ms.withColumn("block", F.floor(F.col("pos") / block))
    return _meet(left, _pieces(ranges, block), [*keys, "block"]).filter((F.col("pos") >= F.col("from_idx")) & (F.col("pos") < F.col("to_idx")))


def _answer(ranges: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _meet(ranges, found, [*keys, "range_id"], "left")


def range_sum(ms: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By a scan of the positions in each range."""
    found = _within(ms, ranges, keys).groupBy(*keys, "range_id").agg(F.sum("ms").alias("sum"))
    return _answer(ranges, found, keys)


def islands(ms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of values that fall by one: keys, first, n, top. Inside, the value at first + i is top - i."""
    w = Window.partitionBy(*keys).orderBy("pos")
    head = F.coalesce((F.col("ms") != F.lag("ms").over(w) - 1).cast("int"), F.lit(1))
    return ms.withColumn("head", head).withColumn("run", F.sum("head").over(w)).groupBy(*keys, "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.max("ms").cast("long").alias("top"))


def range_sum_runs(ms: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By arithmetic series over the runs that a range meets."""
    return sum_over_runs(islands(ms, keys), ranges, keys)


def sum_over_runs(runs: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As range_sum_runs, from the runs (as `islands` gives them)."""
    runs = runs.select(*keys, "first", "n", "top", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("block"))
    a = F.greatest("first", "from_idx", F.col("block") * BLOCK)
    z = F.least(F.col("first") + F.col("n"), F.col("to_idx"), (F.col("block") + 1) * BLOCK)
    met = _meet(runs, _pieces(ranges, BLOCK), [*keys, "block"]).withColumns({"a": a, "len": z - a}).filter("len > 0")
    base = F.col("top") - (F.col("a") - F.col("first"))
    part = base * F.col("len") - F.floor(F.col("len") * (F.col("len") - 1) / 2)
    return _answer(ranges, met.groupBy(*keys, "range_id").agg(F.sum(part).alias("sum")), keys)


def prefix_sums(ms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The index for sums: keys, pos, total (of the values up to and with pos)."""
    return ms.select(*keys, "pos", F.sum("ms").over(Window.partitionBy(*keys).orderBy("pos")).alias("total"))


def range_sum_indexed(index: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By two lookups in prefix sums."""
    size = index.groupBy(*keys).agg(F.max("pos").alias("top"))
    cut = _meet(ranges, size, keys, "left").withColumns({"__a": F.greatest(F.col("from_idx"), F.lit(0)) - 1, "__z": F.least(F.col("to_idx") - 1, F.col("top"))})
    ends = _meet(cut, index.select(*keys, F.col("pos").alias("__z"), F.col("total").alias("hi")), [*keys, "__z"], "left")
    ends = _meet(ends, index.select(*keys, F.col("pos").alias("__a"), F.col("total").alias("lo")), [*keys, "__a"], "left")
    return ends.select(*ranges.columns, F.when(F.col("__z") > F.col("__a"), F.col("hi") - F.coalesce("lo", F.lit(0))).alias("sum"))


def _best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest value and its leftmost place of each range."""
    return rows.groupBy(*keys, "range_id").agg(F.max(F.struct("ms", (-F.col("pos")).alias("neg"))).alias("b")).select(*keys, "range_id", (-F.col("b.neg")).alias("max_index"), F.col("b.ms").alias("max_value"))


def range_max(ms: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By a scan; the leftmost of equal maxima."""
    return _answer(ranges, _best(_within(ms, ranges, keys), keys), keys)


def range_max_runs(ms: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only a run's first position in the range can be its maximum."""
    return max_over_runs(islands(ms, keys), ranges, keys)


def max_over_runs(runs: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As range_max_runs, from the runs (as `islands` gives them)."""
    runs = runs.select(*keys, "first", "n", "top", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("block"))
    met = _meet(runs, _pieces(ranges, BLOCK), [*keys, "block"]).withColumn("pos", F.greatest("first", "from_idx")).filter((F.col("pos") < F.col("first") + F.col("n")) & (F.col("pos") < F.col("to_idx")))
    return _answer(ranges, _best(met.withColumn("ms", F.col("top") - (F.col("pos") - F.col("first"))), keys), keys)


def block_index(ms: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """The block index: keys, block, sum, ms (largest value), pos (its leftmost place); also of the last, partial block."""
    best = ms.withColumn("block", F.floor(F.col("pos") / block)).groupBy(*keys, "block").agg(F.sum("ms").alias("sum"), F.max(F.struct("ms", (-F.col("pos")).alias("neg"))).alias("b"))
    return best.select(*keys, "block", "sum", F.col("b.ms").alias("ms"), (-F.col("b.neg")).alias("pos"))


def _whole_blocks(ranges: DataFrame, block: int) -> DataFrame:
    """__lo and __hi: the blocks that lie in the range as a whole are [__lo, __hi)."""
    return ranges.withColumns({"__lo": F.ceil(F.greatest(F.col("from_idx"), F.lit(0)) / block), "__hi": F.floor(F.col("to_idx") / block)})


def range_max_indexed(ms: DataFrame, ranges: DataFrame, keys: Sequence[str], block: int = 4, index: DataFrame | None = None) -> DataFrame:
    """Head and tail by a scan of less than a block each, whole blocks by a sparse table over the block index
    (made here if none is given).

    Level k of the table holds the best of 2^k blocks; two overlapping entries answer a
    range, so the lookups are equality joins whatever the range's length.
    """
    size = ms.groupBy(*keys).agg((F.max("pos") + 1).alias("__m"))
    cut = _whole_blocks(_meet(ranges, size, keys).withColumn("to_idx", F.least("to_idx", "__m")), block)
    ids = [*keys, "range_id"]
    edge = cut.select(*ids, F.explode(F.when(F.col("__lo") < F.col("__hi"), F.array(F.struct(F.col("from_idx").alias("a"), (F.col("__lo") * block).alias("z")), F.struct((F.col("__hi") * block).alias("a"), F.col("to_idx").alias("z")))).otherwise(F.array(F.struct(F.col("from_idx").alias("a"), F.col("to_idx").alias("z"))))).alias("e"))
    edges = edge.select(*keys, F.col("range_id"), F.greatest(F.col("e.a"), F.lit(0)).alias("from_idx"), F.col("e.z").alias("to_idx")).filter("to_idx > from_idx")
    scans = _within(ms, edges, keys).select(*ids, "ms", "pos")
    level = (block_index(ms, keys, block) if index is None else index).select(*keys, "block", F.struct("ms", (-F.col("pos")).alias("neg")).alias("best"))
    w = Window.partitionBy(*keys).orderBy("block")
    widest = cut.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0] or 0
    columns = {"b0": F.col("best")}
    tab = level.withColumns(columns).drop("best")
    for k in range(1, max(1, widest).bit_length()):
        tab = tab.withColumn(f"b{k}", F.greatest(f"b{k - 1}", F.coalesce(F.lead(f"b{k - 1}", 1 << (k - 1)).over(w), F.col(f"b{k - 1}"))))
    levels = max(1, widest).bit_length()
    inner = cut.filter("__hi > __lo").withColumn("k", F.floor(F.log2(F.col("__hi") - F.col("__lo")) + 1e-9).cast("int"))
    inner = inner.select(*ids, "k", F.explode(F.array(F.col("__lo"), F.col("__hi") - F.expr("shiftleft(1, k)"))).alias("block"))
    looked = _meet(inner, tab, [*keys, "block"]).select(*ids, F.coalesce(*(F.when(F.col("k") == i, F.col(f"b{i}")) for i in range(levels))).alias("b")).select(*ids, F.col("b.ms").alias("ms"), (-F.col("b.neg")).alias("pos"))
    return _answer(ranges, _best(scans.unionByName(looked), keys), keys)


def answer(ms: DataFrame, ranges: DataFrame, keys: Sequence[str], op: str = "sum", algorithm: str = "scan", block: int = 0) -> DataFrame:
    """Any combination of operation (sum, max), algorithm (scan, runs) and index (block 0: none)."""
    if op not in ("sum", "max") or algorithm not in ("scan", "runs"):
        raise ValueError("op is sum or max, algorithm is scan or runs")
    if op == "sum":
        return range_sum_indexed(prefix_sums(ms, keys), ranges, keys) if block else (range_sum if algorithm == "scan" else range_sum_runs)(ms, ranges, keys)
    return range_max_indexed(ms, ranges, keys, block) if block else (range_max if algorithm == "scan" else range_max_runs)(ms, ranges, keys)
