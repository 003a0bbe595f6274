"""Navigation of suffix trees, searches in suffix tables, parentheses and unary level-order trees.

A node is a rank interval, a leaf too, and its number is its place in preorder. Each text
is handled where its row is: sorted once, then walked in one pass, with bisection for
lookups. No shuffle is needed, and a long text costs no more than its own tables.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.suffixes import _grow_intervals, sort_suffixes

Interval = tuple[int, int]


class Tree:
    """The suffix tree of one text. A suffix that begins another one is a leaf of its own."""

    def __init__(self, text: str) -> None:
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        order, lcp = sort_suffixes(codes)
        self.n, self.sa, self.lcp = len(codes), order.tolist(), lcp.tolist()
        self.isa = [0] * self.n
        for r, p in enumerate(self.sa):
            self.isa[p] = r
        inner = [(lo, hi, depth) for lo, hi, depth, _, _ in _grow_intervals(self.lcp) if hi > lo] if self.n else []
        leaves = [(r, r, self.n - p) for r, p in enumerate(self.sa)]
        self.nodes = sorted(inner + leaves, key=lambda x: (x[0], -x[1]))
        self.parent, self.children = [-1] * len(self.nodes), defaultdict(list)
        path: list[int] = []
        for v, (lo, _, _) in enumerate(self.nodes):
            while path and self.nodes[path[-1]][1] < lo:
                path.pop()
            if path:
                self.parent[v] = path[-1]
                self.children[path[-1]].append(v)
            path.append(v)
        self.level = defaultdict(list)  # inner nodes of a depth, from left to right
        for v, (lo, hi, depth) in enumerate(self.nodes):
            if hi > lo:
                self.level[depth].append((lo, v))
        self.before = defaultdict(list)  # ranks of the suffixes that a symbol stands before
        for r, p in enumerate(self.sa):
            if p:
                self.before[text[p - 1]].append(r)

    def symbol(self, v: int) -> str:
        """The first symbol of the edge to a node; empty at a text's end and at the root."""
        if self.parent[v] < 0:
            return ""
        at = self.sa[self.nodes[v][0]] + self.nodes[self.parent[v]][2]
        return self.text[at] if at < self.n else ""

    def suffix_link(self, v: int) -> int | None:
        """The node of an inner node's string without its first symbol; none at the root."""
        lo, hi, depth = self.nodes[v]
        if hi == lo or not depth:
            return None
        at = self.level[depth - 1]
        return at[bisect_right(at, (self.isa[self.sa[hi] + 1], len(self.nodes))) - 1][1]

    def back(self, lo: int, hi: int, c: str) -> Interval | None:
        """The interval of c and a string, from that of the string: a Weiner link, or a step of backward search."""
        ranks = self.before.get(c, [])
        a, z = bisect_left(ranks, lo), bisect_right(ranks, hi)
        return (self.isa[self.sa[ranks[a]] - 1], self.isa[self.sa[ranks[z - 1]] - 1]) if a < z else None

    def first(self, c: str) -> Interval | None:
        """The suffixes that begin with a symbol."""
        return self.narrow(0, self.n - 1, 0, c)

    def narrow(self, lo: int, hi: int, depth: int, c: str) -> Interval | None:
        """The part of an interval of depth equal symbols whose next symbol is c: a step of forward search."""
        key = lambda r: self.text[self.sa[r] + depth] if self.sa[r] + depth < self.n else ""
        ranks = range(lo, hi + 1)
        a, z = bisect_left(ranks, c, key=key), bisect_right(ranks, c, key=key)
        return (lo + a, lo + z - 1) if a < z else None


def per_text(texts: DataFrame, keys: Sequence[str], find: Callable[[str], Iterator[tuple]], schema: str, text_col: str = "text") -> DataFrame:
    """keys and the rows (schema) that find gives for each text; null and empty texts have none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        kinds = [types[x.split()[1]] for x in schema.split(", ")]
        for b in batches:
            for i in range(b.num_rows):
                rows = find(b.column(b.num_columns - 1)[i].as_py())
                while some := list(islice(rows, 20_000)):
                    mine = [c.take(pa.array([i] * len(some))) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*mine, *(pa.array(list(x), k) for x, k in zip(zip(*some), kinds, strict=True))], names=[*b.schema.names[:-1], *names])

    rows = texts.filter(F.length(text_col) > 0).select(*keys, F.col(text_col).cast("string").alias("__t"))
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def nodes(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Every node: id (inverse: lo and hi), lo, hi (leftmost and rightmost leaf), size, depth, is_leaf, suffix (where a
    leaf's suffix begins), parent, child_no, sibling (the next one), first_child, degree, symbol of its edge."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for v, (lo, hi, depth) in enumerate(t.nodes):
            p, below = t.parent[v], t.children.get(v, [])
            mates = t.children[p] if p >= 0 else [v]
            no = bisect_left(mates, v)
            yield v, lo, hi, hi - lo + 1, depth, lo == hi, t.sa[lo] if lo == hi else None, p if p >= 0 else None, no + 1, mates[no + 1] if no + 1 < len(mates) else None, below[0] if below else None, len(below), t.symbol(v)

    return per_text(texts, keys, find, "id long, lo long, hi long, size long, depth long, is_leaf boolean, suffix long, parent long, child_no long, sibling long, first_child long, degree long, symbol string", text_col)


def suffix_links(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, lo, hi, sl_lo, sl_hi of every inner node but the root."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for v, (lo, hi, _) in enumerate(t.nodes):
            if (to := t.suffix_link(v)) is not None:
                yield lo, hi, *t.nodes[to][:2]

    return per_text(texts, keys, find, "lo long, hi long, sl_lo long, sl_hi long", text_col)


def weiner_links(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, lo, hi, symbol, wl_lo, wl_hi for every inner node and every symbol that stands before its string."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for lo, hi, _ in t.nodes:
            for c in t.before if hi > lo else ():
                if to := t.back(lo, hi, c):
                    yield lo, hi, c, *to

    return per_text(texts, keys, find, "lo long, hi long, symbol string, wl_lo long, wl_hi long", text_col)


def edge_classes(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, lo, hi, symbol, kind for every node but the root and every symbol of the text.

    kind: internal_max (several symbols stand before the node's string), internal_nomax
    or leaf, with _wl if the symbol stands before it and _nowl if not.
    """

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        alphabet = sorted(set(text))
        for v, (lo, hi, _) in enumerate(t.nodes):
            if t.parent[v] < 0:
                continue
            found = {c for c in t.before if t.back(lo, hi, c)}
            start = any(t.sa[r] == 0 for r in (t.isa[0],) if lo <= r <= hi)  # the text's start is a neighbour too
            kind = "leaf" if lo == hi else "internal_max" if len(found) + start > 1 else "internal_nomax"
            for c in alphabet:
                yield lo, hi, c, kind + ("_wl" if c in found else "_nowl")

    return per_text(texts, keys, find, "lo long, hi long, symbol string, kind string", text_col)


def edges(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, lo, hi, ch, n_leaves, kind of every edge below every inner node: its first symbol, the leaves under it, and
    what it leads to (end, inner or leaf)."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for v, below in t.children.items():
            for w in below:
                size, ch = t.nodes[w][1] - t.nodes[w][0] + 1, t.symbol(w)
                yield *t.nodes[v][:2], ch, size, "end" if not ch else "inner" if size > 1 else "leaf"

    return per_text(texts, keys, find, "lo long, hi long, ch string, n_leaves long, kind string", text_col)


def lowest_common(texts: DataFrame, pairs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """pairs (keys, i, j: ranks) with lo, hi, depth of the lowest node that holds both: the node whose depth is the least
    common prefix between them, found by two lookups in a sparse table and a bisection."""
    asked = pairs.groupBy(*keys).agg(F.collect_list(F.struct("i", "j")).alias("asked"))
    rows = texts.join(asked, list(keys)).select(*keys, F.to_json(F.struct(F.col(text_col).alias("text"), "asked")).alias("__t"))

    def find(row: str) -> Iterator[tuple]:
        x = json.loads(row)
        t = Tree(x["text"])
        least = [np.array(t.lcp)]
        while 2 << len(least) <= t.n + 1:
            half = 1 << len(least) - 1
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        for ask in x["asked"]:
            i, j = sorted((ask["i"], ask["j"]))
            if i == j:
                yield ask["i"], ask["j"], i, i, t.n - t.sa[i]
                continue
            k = (j - i).bit_length() - 1
            depth = int(min(least[k][i + 1], least[k][j - (1 << k) + 1]))
            at = t.level[depth]
            yield ask["i"], ask["j"], *t.nodes[at[bisect_right(at, (i, len(t.nodes))) - 1][1]]

    return per_text(rows, keys, find, "i long, j long, lo long, hi long, depth long", "__t")


def node_entropy(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, lo, hi, entropy: bits a symbol of what follows each inner node's string."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for v, (lo, hi, _) in enumerate(t.nodes):
            if hi > lo:
                shares = [(t.nodes[w][1] - t.nodes[w][0] + 1) / (hi - lo + 1) for w in t.children[v]]
                yield lo, hi, -sum(x * log2(x) for x in shares) + 0.0

    return per_text(texts, keys, find, "lo long, hi long, entropy double", text_col)


def search(texts: DataFrame, patterns: Sequence[str], keys: Sequence[str], way: str, text_col: str = "text") -> DataFrame:
    """keys, pattern, step, lo, hi after each step that finds something; r_lo, r_hi in the reversed text for way `both`.

    backward adds symbols of the pattern from its end, forward from its start, and both
    from its middle: to the right as far as it goes, then to the left.
    """
    if way not in ("backward", "forward", "both"):
        raise ValueError("way is backward, forward or both")

    def one_way(t: Tree, p: str) -> Iterator[tuple]:
        now = None
        for k, c in enumerate(reversed(p) if way == "backward" else p):
            now = t.first(c) if not k else t.back(*now, c) if way == "backward" else t.narrow(*now, k, c)
            if not now:
                return
            yield p, k + 1, *now, None, None

    def add(back: Tree, along: Interval, other: Interval, c: str) -> tuple[Interval, Interval] | None:
        """c before a string: the interval in back, and in the reversed text, where c then follows."""
        to = back.back(*along, c)
        if not to:
            return None
        smaller = sum(bisect_right(r, along[1]) - bisect_left(r, along[0]) for x, r in back.before.items() if x < c)
        smaller += along[0] <= back.isa[0] <= along[1]  # the text's start comes before all symbols
        return to, (other[0] + smaller, other[0] + smaller + to[1] - to[0])

    def both_ways(t: Tree, r: Tree, p: str) -> Iterator[tuple]:
        mid = len(p) // 2
        a, z = t.first(p[mid]), r.first(p[mid])
        k = 1
        while a and z:
            yield p, k, *a, *z
            k += 1
            if k > len(p):
                return
            if mid + k <= len(p):
                now = add(r, z, a, p[mid + k - 1])
                z, a = now or (None, None)
            else:
                now = add(t, a, z, p[len(p) - k])
                a, z = now or (None, None)

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        r = Tree(text[::-1]) if way == "both" else None
        for p in patterns:
            if p:
                yield from both_ways(t, r, p) if way == "both" else one_way(t, p)

    out = per_text(texts, keys, find, "pattern string, step long, lo long, hi long, r_lo long, r_hi long", text_col)
    return out if way == "both" else out.drop("r_lo", "r_hi")


def intervals(texts: DataFrame, patterns: Sequence[str], keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys, pattern, lo, hi, n: the ranks of suffixes that begin with each pattern that occurs, by forward search."""

    def find(text: str) -> Iterator[tuple]:
        t = Tree(text)
        for p in sorted(set(patterns) - {""}):
            now: Interval | None = (0, t.n - 1)
            for k, c in enumerate(p):
                now = now and t.narrow(*now, k, c)
            if now:
                yield p, *now, now[1] - now[0] + 1

    return per_text(texts, keys, find, "pattern string, lo long, hi long, n long", text_col)


def enclosing(parens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, i, excess (open ones up to i), enclose of parentheses (keys, i, mate, level).

    enclose is the opening of the nearest pair around an opening, null outside; of a
    closing one, its own opening.
    """
    opening = F.col("i") < F.col("mate")
    marks = parens.filter(opening).select(*keys, "i", F.lit(None).cast("long").alias("mate"), (F.col("level") + 1).alias("level"), F.col("i").alias("mark"))
    rows = parens.select(*keys, "i", "mate", "level", F.lit(None).cast("long").alias("mark"))
    w = Window.partitionBy(*keys, "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.unionByName(rows).withColumn("up", F.last("mark", True).over(w)).filter(F.col("mate").isNotNull())
    return seen.select(*keys, "i", F.when(opening, F.col("level")).otherwise(F.col("level") - 1).alias("excess"), F.when(opening, F.col("up")).otherwise(F.col("mate")).alias("enclose"))


def enclosing_pairs(bits: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pairs (keys, i, j: openings, i's pair before j) with rr_enclose and double_enclose, by the bits (keys, parens: string of ( and )).

    rr_enclose is the first opening between i's closing and j of a pair around j, and
    double_enclose the opening of the nearest pair around both; null if there is none.
    """
    asked = pairs.groupBy(*keys).agg(F.collect_list(F.struct("i", "j")).alias("asked"))
    rows = bits.join(asked, list(keys)).select(*keys, F.to_json(F.struct("parens", "asked")).alias("__t"))

    def find(text: str) -> Iterator[tuple]:
        x = json.loads(text)
        up: list[int] = []
        stack: list[int] = []
        for at, c in enumerate(x["parens"]):
            up.append(stack[-1] if c == "(" and stack else -1)
            if c == "(":
                stack.append(at)
            else:
                stack.pop()
        for ask in x["asked"]:
            i, j = ask["i"], ask["j"]
            last, k = None, up[j]
            while k > i:
                last, k = k, up[k]
            yield i, j, last, k if k >= 0 else None

    return per_text(rows, keys, find, "i long, j long, rr_enclose long, double_enclose long", "__t")


def louds(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bits of a tree (keys, node, parent, rank: the order of nodes, level by level): a 1 and a 0 for each child, node by node."""
    degree = nodes.groupBy(*keys, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    each = nodes.join(degree, [*keys, "node"], "left").select(*keys, "rank", F.concat(F.lit("1"), F.repeat(F.lit("0"), F.coalesce("degree", F.lit(0)).cast("int"))).alias("code"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "code"))).alias("x"))
    return lists.select(*keys, F.array_join(F.transform("x", lambda x: x["code"]), "").alias("bits"))


def louds_nodes(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v, degree, parent, first_child of every node, read off the bits: zero number z is the edge to node z."""
    rows = trees.select(*keys, F.posexplode(F.split("bits", "")).alias("at", "bit"))
    w = Window.partitionBy(*keys).orderBy("at")
    rows = rows.withColumn("ones", F.sum(F.when(F.col("bit") == "1", 1).otherwise(0)).over(w))
    edges = rows.filter("bit = '0'").select(*keys, (F.col("at") + 1 - F.col("ones")).cast("long").alias("v"), (F.col("ones") - 1).alias("parent"))
    ones = rows.filter("bit = '1'").select(*keys, (F.col("ones") - 1).alias("v"), "at", F.lead("at").over(w).alias("next"))
    size = trees.select(*keys, F.length("bits").alias("n"))
    degree = ones.join(size, list(keys)).select(*keys, "v", (F.coalesce("next", "n") - F.col("at") - 1).cast("long").alias("degree"), (F.col("at") - F.col("v") + 1).cast("long").alias("child"))
    return degree.join(edges, [*keys, "v"], "left").select(*keys, "v", "degree", "parent", F.when(F.col("degree") > 0, F.col("child")).alias("first_child"))
