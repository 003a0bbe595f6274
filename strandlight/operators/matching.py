"""Matching statistics: for each query position, the longest prefix from there that occurs in a text.

Texts are a collection: a match lies inside one text. Positions count code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of texts that the automaton strategy takes; beyond it, `seed` is used.
AUTOMATON_CHARS = 1_000_000
#: Code points of a piece of a query, pieces that are read in step, code points of queries that are handled together, and
#: entries of a table of states and symbols.
PIECE, AT_ONCE, BATCH_CHARS, DENSE = 1024, 4096, 1 << 21, 1 << 23
#: Rows that are broadcast at most.
BROADCAST_ROWS = 500_000
STRATEGIES = ("auto", "automaton", "seed", "prefix")


@dataclass(frozen=True)
class Flags:
    """How the sequential engine would walk; combinations that contradict each other raise ValueError.

    All walks give the same vector, so a flag changes no row: strategy() names the
    physical strategy that answers them.
    """

    double_rank: bool = False
    lazy: bool = False
    rank_fail: bool = False
    use_maxrep: bool = False
    use_maxrep_rc: bool = False
    answer: bool = False
    avg: bool = False

    def __post_init__(self) -> None:
        maxrep = self.use_maxrep or self.use_maxrep_rc
        rules = [
            (self.use_maxrep and self.use_maxrep_rc, "both kinds of maximal repeats"),
            (self.lazy and maxrep, "lazy links and maximal repeats"),
            (not self.double_rank and maxrep, "single ranks and maximal repeats"),
            (not self.rank_fail and maxrep, "maximal repeats without failing ranks"),
            (not self.double_rank and self.rank_fail, "single ranks and failing ranks"),
            (self.answer and self.avg, "the values and their average"),
        ]
        for bad, what in rules:
            if bad:
                raise ValueError(f"not both: {what}")

    def strategy(self) -> str:
        return "auto"


class SuffixAutomaton:
    """Substrings of a collection, read backwards, with the number of their occurrences."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        last, self.size = 0, 0
        for k, text in enumerate(texts):
            for c in [*map(ord, reversed(text)), -1 - k]:  # separators differ and occur in no query
                last = self._extend(last, c)
            self.size += len(text) + 1
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def _extend(self, last: int, c: int) -> int:
        now = self._state({}, self.length[last] + 1, 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p < 0:
            self.link[now] = 0
            return now
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[now] = q
            return now
        copy = self._state(dict(self.next[q]), self.length[p] + 1, 0)
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[now] = copy
        return now

    def _state(self, edges: dict[int, int], length: int, count: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.count.append(count)
        return len(self.link) - 1

    def match(self, text: str) -> tuple[list[int], list[int]]:
        """(length, occurrences) for each position of text. An empty match occurs at every place and every end."""
        edges, link, length, count = self.next, self.link, self.length, self.count
        ms, freq = [0] * len(text), [0] * len(text)
        v = size = 0
        for i in range(len(text) - 1, -1, -1):
            c = ord(text[i])
            while v and c not in edges[v]:
                v = link[v]
                size = length[v]
            if c in edges[v]:
                v = edges[v][c]
                size += 1
            ms[i], freq[i] = size, count[v] if size else self.size
        return ms, freq


class Matcher:
    """The automaton in flat arrays, for many texts in step.

    Texts are read backwards, so they are cut into pieces that begin some places further
    on: a match that ends before the piece does is a match of the text. Where one does
    not, the piece is read again from further away. A step moves all pieces by one code
    point. With few states a table has, for each state and symbol, where the nearest
    suffix state with that symbol leads and how long its own string is; with many, edges
    are looked up and suffix links followed.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        built = SuffixAutomaton(texts)
        self.size = built.size
        self.link, self.length, self.count = (np.array(x, t) for x, t in ((built.link, np.int32), (built.length, np.int32), (built.count, np.int64)))
        edges = [(v, c, to) for v, out in enumerate(built.next) for c, to in out.items() if c >= 0]
        state, symbol, to = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.empty(0, np.int64),) * 3
        self.symbols = np.unique(symbol)  # code 0 is a symbol of no text
        self.width = len(self.symbols) + 1
        key = state * self.width + np.searchsorted(self.symbols, symbol) + 1
        order = np.argsort(key)
        self.key, self.to = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0).astype(np.int32)
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def prepare(self) -> None:
        """Make the table, if it is small enough. It is not sent along with the arrays."""
        n = len(self.link)
        if n * self.width > DENSE or self.table:
            return
        lead, own = np.zeros((n, self.width), np.int32), np.full((n, self.width), -1, np.int32)
        state, symbol = self.key[:-1] // self.width, self.key[:-1] % self.width
        at = np.searchsorted(state, np.arange(n + 1))
        for v in np.argsort(self.length, kind="stable").tolist():
            if self.link[v] >= 0:
                lead[v], own[v] = lead[self.link[v]], own[self.link[v]]
            mine = slice(at[v], at[v + 1])
            lead[v, symbol[mine]], own[v, symbol[mine]] = self.to[:-1][mine], self.length[v]
        self.table = lead.ravel(), own.ravel()

    def _step(self, state: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table:
            at = state * self.width + c
            return self.table[0][at], np.minimum(size, self.table[1][at]) + 1
        state, size = state.copy(), size.copy()
        left = np.arange(len(state))
        while len(left):
            key = state[left].astype(np.int64) * self.width + c[left]
            at = np.searchsorted(self.key, key)
            hit = self.key[at] == key
            state[left[hit]] = self.to[at[hit]]
            size[left[hit]] += 1
            left = left[~hit]
            root = state[left] == 0
            size[left[root]] = 0
            left = left[~root]
            state[left] = self.link[state[left]]
            size[left] = self.length[state[left]]
        return state, size

    def match(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lengths, occurrences) for each position of each text. An empty match occurs at every place and every end."""
        self.prepare()
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.searchsorted(self.symbols, flat)
        known = place < len(self.symbols)
        known[known] = self.symbols[place[known]] == flat[known]
        codes = np.where(known, place + 1, 0).astype(np.int32)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - begins) // PIECE)
        owner = np.repeat(np.arange(len(texts)), n)
        start = begins[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        stop, limit = np.minimum(start + PIECE, ends[owner]), ends[owner]
        ms, freq = np.zeros(len(flat), np.int32), np.full(len(flat), self.size, np.int64)
        ahead = PIECE // 4
        while len(start):
            far = []
            for k in range(0, len(start), AT_ONCE):
                part = slice(k, k + AT_ONCE)
                far.append(self._pieces(codes, start[part], stop[part], np.minimum(stop[part] + ahead, limit[part]), limit[part], ms, freq))
            again = np.concatenate(far)
            start, stop, limit = start[again], stop[again], limit[again]
            ahead *= 4
        cut = lambda x: np.split(x, ends[:-1])
        return list(zip(cut(ms), cut(freq), strict=True))

    def _pieces(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, begin: np.ndarray, limit: np.ndarray, ms: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Fill ms and freq from stop down to start, read from begin on; gives the pieces that must begin further on."""
        order = np.argsort(start - begin, kind="stable")  # the longest first
        lo, hi, at = start[order], stop[order], begin[order].copy()
        length = at - lo
        state, size, touched = np.zeros(len(lo), np.int32), np.zeros(len(lo), np.int32), np.zeros(len(lo), bool)
        live = len(lo)
        for t in range(int(length[0]) if live else 0):
            while length[live - 1] <= t:
                live -= 1
            at[:live] -= 1
            state[:live], size[:live] = self._step(state[:live], size[:live], codes[at[:live]])
            mine = np.flatnonzero(at[:live] < hi[:live])
            where = at[mine]
            ms[where] = size[mine]
            some = size[mine] > 0
            freq[where[some]] = self.count[state[mine[some]]]
            freq[where[~some]] = self.size
            touched[mine] |= size[mine] == t + 1  # the match reaches where the reading began
        out = np.zeros(len(lo), bool)
        out[order] = touched & (begin[order] < limit[order])
        return out


def _matching(matcher: Matcher, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            begin, held = 0, 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or held > BATCH_CHARS:
                    found = matcher.match([x.as_py() or "" for x in texts[begin:i]])
                    columns = [*(c[begin:i] for c in b.columns[:-1]), pa.array([x for x, _ in found], pa.list_(pa.int32()))]
                    if counted:
                        columns.append(pa.array([x for _, x in found], pa.list_(pa.int64())))
                    del found
                    yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "ms", "freq"][: len(columns)])
                    begin, held = i, 0
                if i < b.num_rows:
                    held += len(texts[i].as_py() or "")

    return run


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def ms_vectors(texts: DataFrame, queries: DataFrame, keys: Sequence[str], text_col: str = "text", query_col: str = "text", counted: bool = True) -> DataFrame:
    """keys, ms (array<int>) and, if counted, freq (array<long>) of each query, by an automaton of all texts that is built once.

    The texts must have AUTOMATON_CHARS code points at most: they come to the driver, and
    the automaton goes to every worker. This is checked before.
    """
    size = _chars(texts, text_col)
    if size > AUTOMATON_CHARS:
        raise ValueError(f"the texts have {size} code points; an automaton takes {AUTOMATON_CHARS}")
    known = texts.select(F.col(text_col).alias("t")).filter("t is not null").groupBy("t").count().collect()
    index = [r[0] for r in sorted(known) for _ in range(r[1])]  # repeated texts count as often as they stand there
    rows = queries.select(*keys, F.col(query_col).cast("string"))
    return rows.mapInArrow(_matching(Matcher(index), counted), _schema(queries, keys, "ms array<int>" + ", freq array<bigint>" * counted))


def _chars(texts: DataFrame, text_col: str) -> int:
    return texts.agg(F.coalesce(F.sum(F.length(text_col) + 1), F.lit(0))).first()[0]


def positions(df: DataFrame, keys: Sequence[str], text_col: str, k: int) -> DataFrame:
    """keys, pos, gram (k code points from pos, fewer at the end), rest (the text from pos).

    Texts are cut into pieces first: a substring far into a long text costs as much as
    all code points before it.
    """
    step = 512
    pieces = df.select(*keys, F.col(text_col).alias("__t")).withColumn("__p", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("__t") - 1), F.lit(step))))
    cut = pieces.select(*keys, F.col("__p"), F.col("__t").substr(F.col("__p") + 1, F.lit(step + k - 1)).alias("__s"), "__t").withColumn("__n", F.least(F.lit(step), F.length("__t") - F.col("__p"))).filter("__n > 0")
    each = cut.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return each.select(*keys, (F.col("__p") + F.col("__i")).cast("long").alias("pos"), F.col("__s").substr(F.col("__i") + 1, F.lit(k)).alias("gram"))


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """df for a join with positions: broadcast if it has at most so few rows, and else merged. The planner's own estimates
    follow the compressed texts, not the positions that are made of them."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _prefix_lengths(grams: DataFrame, known: DataFrame, keys: Sequence[str], k: int, n_known: int) -> DataFrame:
    """keys, pos and the longest prefix (k at most) of gram that is a prefix of one of the n_known known grams, by bisection:
    whether a prefix occurs only falls with its length."""
    found = grams.select(*keys, "pos", "gram", F.lit(0).alias("ms"))
    step = 1 << (k.bit_length() - 1)
    while step:
        sizes = range(step, k + 1, 2 * step)  # the lengths that are asked for now
        heads = known.select("gram").distinct().select("gram", F.explode(F.array(*map(F.lit, sizes))).alias("len")).filter(F.length("gram") >= F.col("len"))
        heads = heads.select(F.col("gram").substr(F.lit(1), F.col("len")).alias("head"), F.lit(step).alias("more")).distinct()
        longer = F.col("ms") + step
        asked = found.withColumn("head", F.when(F.length("gram") >= longer, F.col("gram").substr(F.lit(1), longer)))
        found = asked.join(_beside(heads, n_known * len(sizes)), "head", "left").select(*keys, "pos", "gram", (F.col("ms") + F.coalesce("more", F.lit(0))).alias("ms"))
        step //= 2
    return found.select(*keys, "pos", "ms")


def ms_prefix(texts: DataFrame, queries: DataFrame, keys: Sequence[str], text_col: str = "text", query_col: str = "text", longest: int = 32) -> DataFrame:
    """keys, pos, ms by joins on prefixes, doubling their length until no match is cut short."""
    texts = texts.select(F.col(text_col).alias("t")).filter("t is not null")
    q = queries.select(*keys, F.col(query_col).alias("t")).filter("t is not null")
    size = _chars(texts, "t")
    while True:
        grams, known = positions(q, keys, "t", longest), positions(texts, [], "t", longest)
        full = F.length("gram") == longest
        if grams.filter(full).select("gram").join(_beside(known.filter(full).select("gram").distinct(), size), "gram", "left_semi").isEmpty():
            return _prefix_lengths(grams, known, keys, longest, size)
        longest *= 2


def ms_seed(texts: DataFrame, queries: DataFrame, keys: Sequence[str], text_col: str = "text", query_col: str = "text", seed: int = 12) -> DataFrame:
    """keys, pos, ms by seeds: matches shorter than a seed come from prefixes, and the others from extending every
    place where the seed occurs. For collections of any size; only what was counted before is broadcast, and no match is cut short."""
    t = texts.select(F.col(text_col).alias("t")).filter("t is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "t")
    q = queries.select(*keys, F.col(query_col).alias("t")).filter("t is not null")
    size = _chars(texts, text_col)
    grams, known = positions(q, keys, "t", seed), positions(t, ["id"], "t", seed)
    short = _prefix_lengths(grams, known, keys, seed, size).filter(F.col("ms") < seed)
    full = F.length("gram") == seed
    met = grams.filter(full).join(_beside(known.filter(full).select("gram", "id", F.col("pos").alias("at")), size), "gram").select(*keys, "pos", "id", "at")
    a, b = F.col("__q"), F.col("x.t")
    whole = q.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("t").alias("__q"))
    own = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))  # a key may be null
    both = met.join(whole.hint("merge"), own).join(_beside(t.alias("x"), size), "id")
    room = F.least(F.length(a) - F.col("pos"), F.length(b) - F.col("at"))
    ends = both.select(*keys, "pos", a.substr((F.col("pos") + 1).cast("int"), room.cast("int")).alias("u"), b.substr((F.col("at") + 1).cast("int"), room.cast("int")).alias("v"))
    same = common_prefix("u", "v")
    long = ends.select(*keys, "pos", same.alias("m")).groupBy(*keys, "pos").agg(F.max("m").cast("int").alias("ms"))
    return short.unionByName(long)  # a position with a whole seed has a place where it occurs


def common_prefix(u: str, v: str) -> Column:
    """The length of the common prefix of two strings, by bisection: whether prefixes of a length agree only falls with the length."""
    return F.expr(f"aggregate(reverse(sequence(0, 30)), 0, (m, k) -> if(m + shiftleft(1, k) <= least(length({u}), length({v})) and left({u}, m + shiftleft(1, k)) = left({v}, m + shiftleft(1, k)), m + shiftleft(1, k), m))")


def ms_build(texts: DataFrame, queries: DataFrame, keys: Sequence[str] = ("query_id",), text_col: str = "text", query_col: str = "text", strategy: str = "auto") -> DataFrame:
    """keys, pos, ms for every position of every query. Null texts and queries have no positions.

    auto takes the automaton for a collection of AUTOMATON_CHARS code points at most, and
    seeds otherwise. All strategies give the same rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "auto":
        strategy = "automaton" if _chars(texts, text_col) <= AUTOMATON_CHARS else "seed"
    if strategy == "prefix":
        return ms_prefix(texts, queries, keys, text_col, query_col)
    if strategy == "seed":
        return ms_seed(texts, queries, keys, text_col, query_col)
    vectors = ms_vectors(texts, queries, keys, text_col, query_col, counted=False)
    return vectors.select(*keys, F.posexplode("ms").alias("pos", "ms")).withColumn("pos", F.col("pos").cast("long"))


def ms_arrays(texts: DataFrame, queries: DataFrame, keys: Sequence[str] = ("query_id",), text_col: str = "text", query_col: str = "text") -> DataFrame:
    """keys, ms (array<int>): each query's vector in one row; queries without positions have none."""
    if _chars(texts, text_col) <= AUTOMATON_CHARS:
        return ms_vectors(texts, queries, keys, text_col, query_col, counted=False).filter(F.size("ms") > 0)
    rows = ms_seed(texts, queries, keys, text_col, query_col).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ms"))).alias("x"))
    return rows.select(*keys, F.transform("x", lambda x: x["ms"]).alias("ms"))


def ms_frequency(texts: DataFrame, queries: DataFrame, keys: Sequence[str] = ("query_id",), text_col: str = "text", query_col: str = "text") -> DataFrame:
    """keys, pos, ms, freq: also how often each match occurs. An empty match occurs before every code point and at every end.

    With more than AUTOMATON_CHARS code points of texts, the matches come from seeds and
    their occurrences are counted by joins.
    """
    size = _chars(texts, text_col)
    if size > AUTOMATON_CHARS:
        return _joined_frequency(texts, queries, keys, text_col, query_col, size)
    vectors = ms_vectors(texts, queries, keys, text_col, query_col)
    return vectors.select(*keys, F.posexplode(F.arrays_zip("ms", "freq")).alias("pos", "x")).select(*keys, F.col("pos").cast("long").alias("pos"), "x.ms", "x.freq")


def _joined_frequency(texts: DataFrame, queries: DataFrame, keys: Sequence[str], text_col: str, query_col: str, size: int, seed: int = 12) -> DataFrame:
    ms = ms_seed(texts, queries, keys, text_col, query_col, seed)
    q = queries.select(*keys, F.col(query_col).alias("__q")).filter("__q is not null")
    matched = ms.join(q, list(keys)).select(*keys, "pos", "ms", F.col("__q").substr((F.col("pos") + 1).cast("int"), F.col("ms")).alias("w"))
    asked = matched.filter("ms > 0").select("w").distinct().withColumn("head", F.col("w").substr(1, seed))
    t = texts.select(F.col(text_col).alias("t")).filter("t is not null").select(F.monotonically_increasing_id().alias("id"), "t")
    grams = positions(t, ["id"], "t", seed)
    short = grams.select("gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("n")).select(F.col("gram").substr(F.lit(1), F.col("n")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("freq"))
    some = asked.filter(F.length("w") <= seed).select("w").join(short, "w")
    places = asked.filter(F.length("w") > seed).join(grams, F.col("head") == F.col("gram")).select("w", "id", F.col("pos").alias("at"))
    held = places.join(t, "id").filter(F.col("t").substr((F.col("at") + 1).cast("int"), F.length("w")) == F.col("w"))
    counts = some.unionByName(held.groupBy("w").agg(F.count(F.lit(1)).alias("freq")))
    return matched.join(counts, "w", "left").select(*keys, "pos", "ms", F.when(F.col("ms") == 0, F.lit(size).cast("long")).otherwise(F.col("freq")).alias("freq"))


def ms_pairs(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """text_id, query_id, pos, ms of every text (text_id, s) with every query (query_id, t).

    All pairs are asked for; each is matched in its own row, with an automaton of its
    text, and neither side is collected.
    """
    pairs = texts.crossJoin(queries).filter("s is not null and t is not null").select("text_id", "query_id", "s", "t")
    found = pairs.mapInArrow(_pair_matcher, _schema(pairs, ["text_id", "query_id"], "ms array<int>"))
    return found.select("text_id", "query_id", F.posexplode("ms").alias("pos", "ms")).withColumn("pos", F.col("pos").cast("long"))


def _pair_matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, automaton = None, None
    for b in batches:
        found = []
        for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if s != text or automaton is None:
                text, automaton = s, SuffixAutomaton([s])
            found.append(automaton.match(t)[0])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["text_id", "query_id", "ms"])
