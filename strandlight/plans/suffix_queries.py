"""Suffix tables of all benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.operators import suffixes as sx
from strandlight.operators import trees
from strandlight.plans.registry import query, read

K = ["item_id"]

#: sx(item_id, t, n, sa_pos, sfx, sa_rank)
SX = """with p as (select item_id, text t, length(text) n, unnest(range(0, length(text))) sa_pos from benchmark),
s as (select *, substr(t, sa_pos + 1) sfx from p),
sx as (select *, row_number() over (partition by item_id order by sfx) - 1 sa_rank from s)"""
LCP = SX + """, l0 as (select *, lag(sfx) over (partition by item_id order by sa_rank) before from sx),
lx as (
  select item_id, sa_rank, sa_pos, t, n,
         case when before is null then 0 else coalesce(len(list_filter(range(1, least(length(sfx), length(before)) + 1), lambda k: left(sfx, k) = left(before, k))), 0) end lcp
  from l0)"""
NODES = LCP + """, d as (select distinct item_id, lcp depth from lx union select distinct item_id, 0 from lx),
brk as (select d.item_id, d.depth, x.sa_rank, sum((x.lcp < d.depth)::int) over (partition by d.item_id, d.depth order by x.sa_rank) g from d join lx x using (item_id)),
iv as (select item_id, depth, min(sa_rank) lo, max(sa_rank) hi from brk group by item_id, depth, g having count(*) > 1),
nd as (select item_id, lo, hi, max(depth) depth from iv group by all)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark")


def _table(spark: SparkSession, d: str) -> DataFrame:
    return sx.suffix_table(_texts(spark, d), K)


@query("suffix_array", SX + " select item_id, sa_rank, sa_pos from sx")
def suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select(*K, "sa_rank", "sa_pos")


@query("suffix_array_long", SX + " select item_id, sa_rank, sa_pos from sx")
def suffix_array_long(spark: SparkSession, d: str) -> DataFrame:
    """The same by doubling over all tasks, as a text needs that one task cannot sort."""
    return sx.long_suffix_array(_texts(spark, d), K)


@query("suffix_array_reverse", """with r as (select item_id, string_agg(c, '' order by i desc) text from (
    select item_id, i, substr(text, i, 1) c from benchmark, lateral (select unnest(range(1, length(text) + 1)) i)) group by 1),
  p as (select item_id, text t, unnest(range(0, length(text))) sa_pos from r)
  select item_id, row_number() over (partition by item_id order by substr(t, sa_pos + 1)) - 1 sa_rank, sa_pos from p""")
def suffix_array_reverse(spark: SparkSession, d: str) -> DataFrame:
    return sx.suffix_table(_texts(spark, d), K, backwards=True).select(*K, "sa_rank", "sa_pos")


@query("isa", SX + " select item_id, sa_pos pos, sa_rank isa from sx")
def isa(spark: SparkSession, d: str) -> DataFrame:
    return sx.inverse(_table(spark, d), K)


@query("bwt", SX + " select item_id, string_agg(substr(t, case when sa_pos = 0 then n else sa_pos end, 1), '' order by sa_rank) bwt from sx group by 1")
def bwt(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d).groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("sa_rank", "bwt"))).alias("x"))
    return rows.select(*K, F.array_join(F.transform("x", lambda x: x["bwt"]), "").alias("bwt"))


@query("lcp_array", LCP + " select item_id, sa_rank, lcp from lx")
def lcp_array(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select(*K, "sa_rank", "lcp")


@query("psi_lf", SX + """ select a.item_id, a.sa_rank, b.sa_rank psi, c.sa_rank lf from sx a
  join sx b on b.item_id = a.item_id and b.sa_pos = (a.sa_pos + 1) % a.n
  join sx c on c.item_id = a.item_id and c.sa_pos = (a.sa_pos - 1 + a.n) % a.n""")
def psi_lf(spark: SparkSession, d: str) -> DataFrame:
    return sx.psi_lf(_table(spark, d), K)


@query("c_array", SX + " select item_id, symbol, (sum(n) over (partition by item_id order by symbol) - n)::bigint c from (select item_id, left(sfx, 1) symbol, count(*) n from sx group by all)")
def c_array(spark: SparkSession, d: str) -> DataFrame:
    return sx.c_array(_table(spark, d), K)


PATTERNS = ("th", "ing", "an ", "e", "tion", "zzz", "öß")


@query("sa_interval", SX + f""", q as (select unnest([{', '.join(repr(p) for p in PATTERNS)}]) pattern)
  select item_id, pattern, min(sa_rank) lo, max(sa_rank) hi, count(*) n from sx join q on starts_with(sfx, pattern) group by all""")
def sa_interval(spark: SparkSession, d: str) -> DataFrame:
    return trees.intervals(_texts(spark, d), PATTERNS, K)


@query("index_table", LCP + """ select l.item_id, l.sa_rank, l.sa_pos, l.lcp, substr(l.t, l.sa_rank + 1, 1) symbol,
  substr(l.t, case when l.sa_pos = 0 then l.n else l.sa_pos end, 1) bwt, substr(l.t, l.sa_pos + 1) suffix from lx l""")
def index_table(spark: SparkSession, d: str) -> DataFrame:
    """The text's own symbol beside the suffix of the same number."""
    both = _table(spark, d).drop("symbol").join(_texts(spark, d).select(*K, F.col("text").alias("t")), K)
    return both.select(*K, "sa_rank", "sa_pos", "lcp", F.col("t").substr((F.col("sa_rank") + 1).cast("int"), F.lit(1)).alias("symbol"), "bwt", F.col("t").substr((F.col("sa_pos") + 1).cast("int"), F.length("t")).alias("suffix"))


@query("bwt_runs", SX + """, b as (select item_id, sa_rank, substr(t, case when sa_pos = 0 then n else sa_pos end, 1) b from sx)
  select item_id, sum(x)::bigint n_runs from (select item_id, coalesce((b <> lag(b) over (partition by item_id order by sa_rank))::int, 1) x from b) group by 1""")
def bwt_runs(spark: SparkSession, d: str) -> DataFrame:
    return sx.bwt_runs(_table(spark, d), K)


@query("st_nodes", NODES + " select item_id, lo, hi, depth from nd")
def st_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sx.tree_nodes(_table(spark, d), K).select(*K, "lo", "hi", "depth")


@query("st_parent", NODES + """ select a.item_id, a.lo, a.hi, coalesce(arg_max(b.lo, b.depth), -1) parent_lo, coalesce(arg_max(b.hi, b.depth), -1) parent_hi
  from nd a left join nd b on b.item_id = a.item_id and b.lo <= a.lo and b.hi >= a.hi and b.depth < a.depth group by all""")
def st_parent(spark: SparkSession, d: str) -> DataFrame:
    return sx.tree_nodes(_table(spark, d), K).drop("depth")


@query("st_parent_depth", NODES + """ select a.item_id, a.lo, a.hi, count(b.lo) node_depth
  from nd a left join nd b on b.item_id = a.item_id and b.lo <= a.lo and b.hi >= a.hi and b.depth < a.depth group by all""")
def st_parent_depth(spark: SparkSession, d: str) -> DataFrame:
    return sx.node_depths(sx.tree_nodes(_table(spark, d), K), K)


@query("st_lca", NODES + """, q as (select item_id, sa_rank i, sa_rank + 3 j from sx where sa_rank + 3 < n)
  select q.item_id, i, j, arg_max(lo, depth) lo, arg_max(hi, depth) hi, max(depth) depth
  from q join nd on nd.item_id = q.item_id and lo <= i and hi >= j group by all""")
def st_lca(spark: SparkSession, d: str) -> DataFrame:
    """The lowest common node of every suffix and the one three ranks on."""
    table = _table(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy(*K))
    pairs = table.withColumn("n", n).filter("sa_rank + 3 < n").select(*K, F.col("sa_rank").alias("i"), (F.col("sa_rank") + 3).alias("j"))
    return trees.lowest_common(_texts(spark, d), pairs, K)


@query("st_depth", NODES + " select item_id, depth, count(*) n_nodes, sum(hi - lo + 1)::bigint n_leaves from nd group by all")
def st_depth(spark: SparkSession, d: str) -> DataFrame:
    return sx.tree_nodes(_table(spark, d), K).groupBy(*K, "depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_leaves"))


@query("st_edges", NODES + """, e as (select nd.item_id, lo, hi, depth, substr(t, sa_pos + depth + 1, 1) ch, sa_rank from nd join sx on sx.item_id = nd.item_id and sa_rank between lo and hi)
  select *, case when ch = '' then 'end' when n_leaves > 1 then 'inner' else 'leaf' end kind from (select item_id, lo, hi, ch, count(*) n_leaves from e group by all)""")
def st_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge below every node: its first symbol, the leaves under it, and what it leads to."""
    return trees.edges(_texts(spark, d), K)


#: r(item_id, gram, n, n_next, n_prev): repeats of any length. A gram that does not occur twice has no longer repeat, so
#: lengths go as far as some gram occurs twice; single symbols are all there.
GRAMS = """with recursive p as (select item_id, text t, unnest(range(1, length(text) + 1)) i from benchmark),
g(item_id, l, i) as (
  select item_id, 1, i from p
  union all
  select item_id, l + 1, unnest(case when count(*) > 1 then list(i) else [] end) from (
    select g.item_id, l, g.i, substr(t, g.i::int, l::int + 1) w, length(t) n from g join p on p.item_id = g.item_id and p.i = g.i) where i + l <= n group by item_id, l, w),
x as (select g.item_id, substr(t, g.i::int, g.l::int) gram, substr(t, (g.i + g.l)::int, 1) nx, case when g.i > 1 then substr(t, (g.i - 1)::int, 1) else '' end pv from g join p on p.item_id = g.item_id and p.i = g.i),
r as (select item_id, gram, count(*) n, count(distinct nx) n_next, count(distinct pv) n_prev from x group by all)"""


@query("maximal_repeats", GRAMS + " select item_id, gram, n from r where n_next > 1 and n_prev > 1")
def maximal_repeats(spark: SparkSession, d: str) -> DataFrame:
    return sx.maximal_repeats(_texts(spark, d), K)


@query("right_maximal", GRAMS + " select item_id, gram, n from r where n_next > 1")
def right_maximal(spark: SparkSession, d: str) -> DataFrame:
    return sx.right_maximal(_texts(spark, d), K)


def _entropy_sql(k: int) -> str:
    return f"""with g as (select item_id, substr(text, i, {k + 1}) g from benchmark, lateral (select unnest(range(1, length(text) - {k} + 1)) i)),
n as (select item_id, g, left(g, {k}) ctx, count(*)::double n from g group by all)
select item_id, sum(-n * log2(n / m)) / sum(n) entropy from (select *, sum(n) over (partition by item_id, ctx) m from n) group by 1"""


@query("entropy_h0", _entropy_sql(0))
def entropy_h0(spark: SparkSession, d: str) -> DataFrame:
    return sx.entropy(_texts(spark, d), K, 0)


@query("entropy_hk", _entropy_sql(2))
def entropy_hk(spark: SparkSession, d: str) -> DataFrame:
    return sx.entropy(_texts(spark, d), K, 2)
