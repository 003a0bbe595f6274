"""Pattern search and document retrieval: docs (keys, text) and patterns (pattern).

Patterns are looked for all at once: a text is read once, whatever their number. They come
to the driver in parts of PATTERN_CHARS code points at most, and a part is a pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # patterns are then looked for one after the other
    ahocorasick = None

PATTERN_CHARS = 1_000_000


def finder(patterns: Sequence[str]) -> Callable[[str], dict[str, list[int]]]:
    """For a text: the places of each pattern that it holds, overlapping ones too."""
    if ahocorasick is None or not patterns:

        def one_by_one(text: str) -> dict[str, list[int]]:
            found = defaultdict(list)
            for p in patterns:
                i = text.find(p)
                while i >= 0:
                    found[p].append(i)
                    i = text.find(p, i + 1)
            return found

        return one_by_one
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, p)
    automaton.make_automaton()

    def at_once(text: str) -> dict[str, list[int]]:
        found = defaultdict(list)
        for end, p in automaton.iter(text):
            found[p].append(end - len(p) + 1)
        return found

    return at_once


def _parts(patterns: DataFrame) -> Iterator[list[str]]:
    """The distinct patterns that are not empty, in parts of a bounded size."""
    known = patterns.select(F.col("pattern").cast("string").alias("pattern")).filter("pattern <> ''").distinct()
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    parts = max(1, -(-2 * size // PATTERN_CHARS))  # parts by a hash are not all alike
    for k in range(parts if n else 0):
        yield [r[0] for r in known.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).collect()]


def _found(docs: DataFrame, patterns: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """keys, __t, pattern, at (array): each document that holds a pattern, with its places."""
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("__t")).filter("__t is not null")
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "__t string, __f array<struct<pattern:string,at:array<bigint>>>"])
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("at", pa.list_(pa.int64()))]))

    def run(part: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(part)
            for b in batches:
                found = [[{"pattern": p, "at": at} for p, at in find(x.as_py()).items()] for x in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "__f"]).filter(pa.array([bool(f) for f in found], pa.bool_()))

        return each

    out = None
    for part in _parts(patterns):
        one = rows.mapInArrow(run(part), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.mapInArrow(run([]), schema)
    return out.select(*keys, "__t", F.explode("__f").alias("f")).select(*keys, "__t", "f.pattern", "f.at")


def counts(docs: DataFrame, patterns: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, pattern, n: occurrences, overlapping ones too, in documents that have any."""
    return _found(docs, patterns, keys, text_col).select(*keys, "pattern", F.size("at").cast("long").alias("n"))


def locate(docs: DataFrame, patterns: DataFrame, keys: Sequence[str], text_col: str = "text", context: int | None = None) -> DataFrame:
    """keys, pattern, pos of every occurrence; with context, also before and after: that many code points on either side."""
    found = _found(docs, patterns, keys, text_col)
    if context is None:
        return found.select(*keys, "pattern", F.explode("at").alias("pos"))
    each = F.transform("at", lambda p: F.struct(p.alias("pos"), F.substr("__t", (F.greatest(F.lit(0).cast("bigint"), p - context) + 1).cast("int"), F.least(F.lit(context), p).cast("int")).alias("before"), F.substr("__t", (p + F.length("pattern") + 1).cast("int"), F.lit(context)).alias("after")))
    return found.select(*keys, "pattern", F.explode(each).alias("x")).select(*keys, "pattern", "x.*")


def sequences(docs: DataFrame, key: str, numbers: Sequence[int]) -> DataFrame:
    """docs with n, the place of the key among all keys from 0 on, for the places that are asked for.

    Places come from counts of the ranges of keys that a sort makes, so no task sees all keys.
    """
    part = docs.select(key).repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = part.groupBy("p").agg(F.count(F.lit(1)).alias("size"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("p").alias("p2"), before.alias("before"), "first")  # a row a partition
    placed = part.join(F.broadcast(firsts), F.col("p") == F.col("p2")).select(F.col(key).alias("__k"), (F.col("before") + F.col("m") - F.col("first")).alias("n"))
    return docs.join(placed.filter(F.col("n").isin(list(numbers))), F.col(key) == F.col("__k")).drop("__k")


def listing(docs: DataFrame, patterns: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """pattern, key of each document that holds it."""
    return _found(docs, patterns, [key], text_col).select("pattern", key).distinct()


def listing_runs(docs: DataFrame, patterns: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The listing as ranges of consecutive keys: pattern, first, last."""
    at = listing(docs, patterns, key, text_col)
    runs = at.withColumn("__g", F.col(key) - F.row_number().over(Window.partitionBy("pattern").orderBy(key)))
    return runs.groupBy("pattern", "__g").agg(F.min(key).alias("first"), F.max(key).alias("last")).drop("__g")


def document_counts(docs: DataFrame, patterns: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """pattern, n_docs; 0 where no document holds it."""
    n = listing(docs, patterns, key, text_col).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_docs"))
    return patterns.select("pattern").distinct().join(n, "pattern", "left").select("pattern", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def top_documents(docs: DataFrame, patterns: DataFrame, key: str, k: int, text_col: str = "text") -> DataFrame:
    """pattern, rank, key, n: the k documents with the most occurrences; of equals those with the least key."""
    w = Window.partitionBy("pattern").orderBy(F.desc("n"), key)
    return counts(docs, patterns, [key], text_col).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("pattern", "rank", key, "n")


def grep(docs: DataFrame, patterns: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """pattern, key, line_no (from 0), line of each line that holds a pattern."""
    lines = docs.select(key, F.posexplode_outer(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return _found(lines, patterns, [key, "line_no"], "line").select("pattern", key, "line_no", F.col("__t").alias("line"))
