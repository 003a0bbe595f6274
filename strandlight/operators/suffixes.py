"""Suffix tables of texts: one row for each suffix, and what is read off them.

A text is one row, so its suffixes are sorted where the row is; no shuffle is needed,
and many texts spread over the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.sources import stored


def sort_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, longest common prefix of each suffix with the one before) by prefix doubling."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        next_ = np.full(n, -1, np.int64)
        next_[: max(0, n - k)] = rank[k:]
        order = np.lexsort((next_, rank))
        a, b = rank[order], next_[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        levels.append(rank)
        k *= 2
        if rank.max() == n - 1:
            break
    lcp = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    for level, r in reversed(list(enumerate(levels))):
        ok = (x + (1 << level) <= n) & (y + (1 << level) <= n)
        same = np.zeros(n - 1, bool)
        same[ok] = r[x[ok]] == r[y[ok]]
        lcp[1:][same] += 1 << level
        x[same] += 1 << level
        y[same] += 1 << level
    return order, lcp


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sort_suffixes(np.frombuffer((x.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32)) for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))], names=[*b.schema.names, "sa", "lcp"])


def suffix_table(texts: DataFrame, keys: Sequence[str], text_col: str = "text", backwards: bool = False) -> DataFrame:
    """keys, sa_rank, sa_pos, lcp, symbol (first of the suffix), bwt (symbol before it, cyclic). Null texts have no suffixes."""
    source = texts.filter(F.col(text_col).isNotNull()).select(*keys, (F.reverse(text_col) if backwards else F.col(text_col)).alias("__t"))
    schema = ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys), "__t string, sa array<bigint>, lcp array<bigint>"])
    rows = source.mapInArrow(_sorted, schema).withColumn("__c", F.split("__t", ""))
    flat = rows.select(*keys, F.posexplode(F.transform("sa", lambda p, i: F.struct(p.alias("p"), F.get("lcp", i).alias("l"), F.get("__c", p).alias("c"), F.when(p > 0, F.get("__c", p - 1)).otherwise(F.element_at("__c", -1)).alias("b")))).alias("sa_rank", "x"))
    return flat.select(*keys, F.col("sa_rank").cast("long").alias("sa_rank"), F.col("x.p").alias("sa_pos"), F.col("x.l").alias("lcp"), F.col("x.c").alias("symbol"), F.col("x.b").alias("bwt"))


def long_suffix_array(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, sa_rank, sa_pos by prefix doubling over all positions: for texts that one task cannot sort.

    A rank counts the suffixes of the text that are smaller by their first 2^k symbols.
    Suffixes that share it are told apart by the rank 2^k places on; pairs of ranks are
    counted first, and summed in two levels. Lineage is cut after every step.
    """
    at = Window.partitionBy(*keys, "p", "span").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    spans_before = Window.partitionBy(*keys, "p").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))

    def ranked(rows: DataFrame) -> DataFrame:
        """rows (keys, pos, p, q) with the rank by p and q."""
        pairs = rows.groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("q") / (1 << 16)))
        spans = pairs.groupBy(*keys, "p", "span").agg(F.sum("n").alias("n")).select(*keys, "p", "span", before(spans_before).alias("s"))
        ranks = pairs.withColumn("within", before(at)).join(spans, [*keys, "p", "span"]).select(*keys, "p", "q", "n", (F.col("p") + F.col("s") + F.col("within")).alias("r"))
        return stored.checkpointed(rows.join(ranks, [*keys, "p", "q"]).select(*keys, "pos", "r", F.col("n").alias("same")))

    source = texts.filter(F.length(text_col) > 0).select(*keys, F.posexplode(F.split(text_col, "")).alias("pos", "c"))
    now = ranked(source.filter("c <> ''").select(*keys, F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("p"), F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long").alias("q")))
    step = 1
    while (now.agg(F.max("same")).first()[0] or 1) > 1:
        ahead = now.select(*keys, (F.col("pos") - step).alias("pos"), F.col("r").alias("q"))
        now = ranked(now.select(*keys, "pos", F.col("r").alias("p")).join(ahead, [*keys, "pos"], "left").select(*keys, "pos", "p", F.coalesce("q", F.lit(-1).cast("long")).alias("q")))
        step *= 2
    return now.select(*keys, F.col("r").alias("sa_rank"), F.col("pos").alias("sa_pos"))


def _collection_ranks(ids: Sequence, texts: Sequence[str]) -> list[tuple]:
    """(id, pos) of all suffixes in order; of equal suffixes the one of the text that comes first."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + len(texts) for t in texts]
    codes = np.concatenate([np.append(x, i) for i, x in enumerate(parts)]) if parts else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(x) + 1 for x in parts])
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])[:-1]]) if parts else np.empty(0, np.int64)
    order = sort_suffixes(codes)[0]
    order = order[codes[order] >= len(texts)]  # the end marks are no suffixes
    return [(ids[owner[p]], int(p - begin[owner[p]])) for p in order]


def _ranked(df: DataFrame, keys: Sequence[str], find: Callable[[dict], list[tuple]]) -> DataFrame:
    """keys, sa_rank, id, pos from one row for each collection."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "x array<struct<id:bigint,pos:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.int64()), ("pos", pa.int64())]))
        for b in batches:
            rows = [[{"id": i, "pos": p} for i, p in find(x)] for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(rows, kind)], names=[*keys, "x"])

    return df.mapInArrow(run, schema).select(*keys, F.posexplode("x").alias("sa_rank", "x")).select(*keys, F.col("sa_rank").cast("long").alias("sa_rank"), "x.id", "x.pos")


def _gathered(texts: DataFrame, keys: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    rows = texts.filter(F.col(text_col).isNotNull())
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))).alias("docs"))


def collection_table(texts: DataFrame, keys: Sequence[str], id_col: str, text_col: str = "text") -> DataFrame:
    """keys, sa_rank, id, pos: the suffixes of all texts of a collection (keys) in one order. A collection is one row's work."""
    return _ranked(_gathered(texts, keys, id_col, text_col), keys, lambda x: _collection_ranks([y["id"] for y in x["docs"]], [y["text"] for y in x["docs"]]))


def merge_collections(a: DataFrame, b: DataFrame, texts: DataFrame, keys: Sequence[str], id_col: str, text_col: str = "text") -> DataFrame:
    """The table of two collections together from their tables: both orders are kept, and only suffixes of one are
    compared with suffixes of the other. This adds texts to a table without sorting it again."""

    def find(x: dict) -> list[tuple]:
        text = {y["id"]: y["text"] for y in x["docs"]}
        order = [[(y["id"], y["pos"]) for y in x[side] or []] for side in ("a", "b")]
        return list(merge(*order, key=lambda y: (text[y[0]][y[1] :], y[0])))

    side = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sa_rank", "id", "pos"))), lambda y: F.struct(y["id"].alias("id"), y["pos"].alias("pos"))).alias(name))
    rows = _gathered(texts, keys, id_col, text_col).join(side(a, "a"), list(keys), "left").join(side(b, "b"), list(keys), "left")
    return _ranked(rows, keys, find)


def inverse(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.select(*keys, F.col("sa_pos").alias("pos"), F.col("sa_rank").alias("isa"))


def psi_lf(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sa_rank, psi (rank of the suffix one further on) and lf (one before), both cyclic."""
    size = Window.partitionBy(*keys)
    sized = table.withColumn("__n", F.count(F.lit(1)).over(size))
    on = table.select(*keys, F.col("sa_pos").alias("__at"), F.col("sa_rank").alias("__r"))
    psi = sized.withColumn("__at", (F.col("sa_pos") + 1) % F.col("__n")).join(on, [*keys, "__at"]).select(*keys, "sa_rank", "sa_pos", "__n", F.col("__r").alias("psi"))
    return psi.withColumn("__at", (F.col("sa_pos") - 1 + F.col("__n")) % F.col("__n")).join(on, [*keys, "__at"]).select(*keys, "sa_rank", "psi", F.col("__r").alias("lf"))


def c_array(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, symbol, c: how many symbols of the text are smaller."""
    n = table.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, "symbol", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c"))


def bwt_runs(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("sa_rank")
    new = table.withColumn("__new", F.coalesce((F.col("bwt") != F.lag("bwt").over(w)).cast("long"), F.lit(1).cast("long")))
    return new.groupBy(*keys).agg(F.sum("__new").alias("n_runs"))


def _grow_intervals(lcps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(lo, hi, depth, parent lo, parent hi) of every inner node, from the lcp values, with a stack."""
    out, stack = [], [(0, 0)]  # (depth, lo)
    n = len(lcps)
    order = []
    for i in range(1, n + 1):
        d = lcps[i] if i < n else -1
        lo = i - 1
        while stack and stack[-1][0] > d:
            depth, lo = stack.pop()
            order.append((lo, i - 1, depth))
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, lo))
    order.sort(key=lambda x: (x[0], -x[1]))
    path: list[tuple[int, int, int]] = []
    for lo, hi, depth in order:
        while path and path[-1][1] < lo:
            path.pop()
        p = path[-1] if path else (-1, -1, -1)
        out.append((lo, hi, depth, p[0], p[1]))
        path.append((lo, hi, depth))
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("lo", "hi", "depth", "parent_lo", "parent_hi")]))
    for b in batches:
        rows = [[dict(zip(("lo", "hi", "depth", "parent_lo", "parent_hi"), x, strict=True)) for x in _grow_intervals(v.as_py())] if v.as_py() else [] for v in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], names=[*b.schema.names[:-1], "nodes"])


def tree_nodes(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner nodes of each text's suffix tree as rank intervals: keys, lo, hi, depth, parent_lo, parent_hi (-1 at the root).

    The tree has an end mark: a suffix that begins another one is a child of its own, but
    not a node here.
    """
    lists = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sa_rank", "lcp"))).alias("x")).select(*keys, F.transform("x", lambda x: x["lcp"]).alias("lcps"))
    schema = ", ".join([*(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys), "nodes array<struct<lo:bigint,hi:bigint,depth:bigint,parent_lo:bigint,parent_hi:bigint>>"])
    return lists.mapInArrow(_nodes, schema).select(*keys, F.explode("nodes").alias("n")).select(*keys, "n.*")


def node_depths(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lo, hi, node_depth: how many nodes lie above; by pointer doubling over parents."""
    now = nodes.select(*keys, "lo", "hi", F.col("parent_lo").alias("a"), F.col("parent_hi").alias("b"), F.when(F.col("parent_lo") < 0, 0).otherwise(1).alias("d"))
    up = now.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("d").alias("d2"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range((int(deepest) + 1).bit_length()):
        now = now.join(up, [*keys, "a", "b"], "left").select(*keys, "lo", "hi", F.coalesce("a2", F.lit(-1)).alias("a"), F.coalesce("b2", F.lit(-1)).alias("b"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        up = now.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("d").alias("d2"))
    return now.select(*keys, "lo", "hi", F.col("d").cast("long").alias("node_depth"))


def text_repeats(texts: Sequence[str]) -> Iterator[tuple[str, int, bool]]:
    """(gram, n, left-maximal) of every substring of the texts with two distinct symbols or more after it; a text's end is one.

    These are the inner nodes of the suffix tree, of all lengths. Each text has an end mark of its own in the table.
    """
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    codes = np.concatenate([np.append(x, 0x110000 + i) for i, x in enumerate(parts)])
    whole = "\0".join(texts)
    order, lcp = sort_suffixes(codes)
    after = np.minimum(codes, 0x110000)  # all ends are one neighbour
    prev = np.concatenate([[0x110000], after[:-1]])[order]
    changes = np.concatenate([[0], np.cumsum(prev[1:] != prev[:-1])])
    for lo, hi, depth, _, _ in _grow_intervals(lcp.tolist()):
        # next symbols are in order within a node, ends last
        if depth and after[order[lo] + depth] != after[order[hi] + depth]:
            yield whole[order[lo] : order[lo] + depth], hi - lo + 1, bool(changes[hi] > changes[lo])


def _repeats(left: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = ((gram, n) for gram, n, both in text_repeats(b.column(b.num_columns - 1)[i].as_py()) if both or not left)
                while some := list(islice(found, 10_000)):
                    keys = [c.take(pa.array([i] * len(some))) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([g for g, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=[*b.schema.names[:-1], "gram", "n"])

    return run


def _read_repeats(texts: DataFrame, keys: Sequence[str], text_col: str, left: bool) -> DataFrame:
    lists = texts.filter(F.length(text_col) > 0).groupBy(*keys).agg(F.collect_list(text_col).alias("__t"))
    schema = ", ".join([*(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys), "gram string, n bigint"])
    return lists.mapInArrow(_repeats(left), schema)


def maximal_repeats(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, gram, n: the substrings, of any length, with distinct symbols before and after them; a text's start and end are such."""
    return _read_repeats(texts, keys, text_col, True)


def right_maximal(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, gram, n: the substrings, of any length, with distinct symbols after them; a text's end is one."""
    return _read_repeats(texts, keys, text_col, False)


def entropy(texts: DataFrame, keys: Sequence[str], k: int, text_col: str = "text") -> DataFrame:
    """keys, entropy: bits a symbol, given the k symbols before it (k 0: none)."""
    cut = texts.filter(F.length(text_col) > k).select(*keys, F.col(text_col).alias("__t"), F.explode(F.sequence(F.lit(1), F.length(text_col) - k)).alias("__p")).select(*keys, F.col("__t").substr(F.col("__p"), F.lit(k + 1)).alias("g"))
    n = cut.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n")).withColumn("ctx", F.substring("g", 1, k) if k else F.lit(""))
    ctx = n.groupBy(*keys, "ctx").agg(F.sum("n").alias("m"))
    both = n.join(ctx, [*keys, "ctx"])
    return both.groupBy(*keys).agg((F.sum(-F.col("n") * F.log2(F.col("n") / F.col("m"))) / F.sum("n")).alias("entropy"))
