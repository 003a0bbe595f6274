"""Navigation of the suffix trees of all benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.operators import sequences as sq
from strandlight.operators import suffixes as sx
from strandlight.operators import trees
from strandlight.plans.registry import query
from strandlight.plans.suffix_queries import NODES, PATTERNS, SX, K, _table, _texts

#: kid: children of inner nodes, by the symbol after the node's string; a suffix that ends there is a child of its own.
KIDS = NODES + """,
kid as (
  select nd.item_id, lo, hi, depth, substr(t, sa_pos + depth + 1, 1) symbol, min(sa_rank) c_lo, max(sa_rank) c_hi
  from nd join sx on sx.item_id = nd.item_id and sa_rank between lo and hi group by all),
al as (
  select item_id, lo, hi, depth, false is_leaf from nd
  union all select item_id, sa_rank, sa_rank, n - sa_pos, true from sx),
num as (select *, row_number() over (partition by item_id order by lo, hi desc) - 1 id from al)"""

_FULL = KIDS + """,
k2 as (select *, row_number() over w child_no, lead(c_lo) over w s_lo, lead(c_hi) over w s_hi from kid window w as (partition by item_id, lo, hi order by c_lo)),
deg as (select item_id, lo, hi, count(*) degree, min(c_lo) f_lo, arg_min(c_hi, c_lo) f_hi from kid group by all)"""


@query("st_navigation", _FULL + """ select v.item_id, v.id, v.lo, v.hi, v.hi - v.lo + 1 size, v.depth, v.is_leaf,
  case when v.is_leaf then sx.sa_pos end suffix, p.id parent, coalesce(k2.child_no, 1) child_no, s.id sibling, f.id first_child,
  coalesce(deg.degree, 0) degree, coalesce(k2.symbol, '') symbol
  from num v join sx on sx.item_id = v.item_id and sx.sa_rank = v.lo
  left join k2 on k2.item_id = v.item_id and k2.c_lo = v.lo and k2.c_hi = v.hi
  left join num p on p.item_id = v.item_id and p.lo = k2.lo and p.hi = k2.hi
  left join num s on s.item_id = v.item_id and s.lo = k2.s_lo and s.hi = k2.s_hi
  left join deg on deg.item_id = v.item_id and deg.lo = v.lo and deg.hi = v.hi
  left join num f on f.item_id = v.item_id and f.lo = deg.f_lo and f.hi = deg.f_hi""")
def st_navigation(spark: SparkSession, d: str) -> DataFrame:
    return trees.nodes(_texts(spark, d), K)


@query("st_child", _FULL + """ select item_id, lo, hi, child_no, c_lo child_lo, c_hi child_hi, symbol from k2 where child_no <= 2""")
def st_child(spark: SparkSession, d: str) -> DataFrame:
    """The first and the second child of every inner node (select_child), and the symbol that leads there (child)."""
    all_ = trees.nodes(_texts(spark, d), K)
    up = all_.select(*K, F.col("id").alias("parent"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    kids = all_.filter("child_no <= 2").select(*K, "parent", "child_no", F.col("lo").alias("child_lo"), F.col("hi").alias("child_hi"), "symbol")
    return kids.join(up, [*K, "parent"]).select(*K, F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"), "child_no", "child_lo", "child_hi", "symbol")


@query("st_suffix_link", NODES + """ select a.item_id, a.lo, a.hi, b.lo sl_lo, b.hi sl_hi
  from nd a join sx x on x.item_id = a.item_id and x.sa_rank = a.hi
  join sx y on y.item_id = a.item_id and y.sa_pos = x.sa_pos + 1
  join nd b on b.item_id = a.item_id and b.depth = a.depth - 1 and y.sa_rank between b.lo and b.hi where a.depth > 0""")
def st_suffix_link(spark: SparkSession, d: str) -> DataFrame:
    return trees.suffix_links(_texts(spark, d), K)


@query("st_weiner_link", NODES + """ select a.item_id, a.lo, a.hi, substr(x.t, x.sa_pos, 1) symbol, min(y.sa_rank) wl_lo, max(y.sa_rank) wl_hi
  from nd a join sx x on x.item_id = a.item_id and x.sa_rank between a.lo and a.hi and x.sa_pos > 0
  join sx y on y.item_id = a.item_id and y.sa_pos = x.sa_pos - 1 group by all""")
def st_weiner_link(spark: SparkSession, d: str) -> DataFrame:
    return trees.weiner_links(_texts(spark, d), K)


@query("st_edge_classes", KIDS + """,
  wl as (select v.item_id, v.lo, v.hi, substr(x.t, x.sa_pos, 1) symbol from al v join sx x on x.item_id = v.item_id and x.sa_rank between v.lo and v.hi where x.sa_pos > 0 group by all),
  mx as (select v.item_id, v.lo, v.hi, count(distinct substr(x.t, x.sa_pos, 1)) filter (where x.sa_pos > 0) + max((x.sa_pos = 0)::int) before
         from al v join sx x on x.item_id = v.item_id and x.sa_rank between v.lo and v.hi group by all),
  sy as (select distinct item_id, left(sfx, 1) symbol from sx),
  big as (select item_id, max(hi) top from nd group by 1)
  select v.item_id, v.lo, v.hi, sy.symbol,
         case when v.is_leaf then 'leaf' when mx.before > 1 then 'internal_max' else 'internal_nomax' end || case when wl.symbol is null then '_nowl' else '_wl' end kind
  from al v join sy using (item_id) join mx on mx.item_id = v.item_id and mx.lo = v.lo and mx.hi = v.hi join big on big.item_id = v.item_id
  left join wl on wl.item_id = v.item_id and wl.lo = v.lo and wl.hi = v.hi and wl.symbol = sy.symbol where v.hi - v.lo < big.top""")
def st_edge_classes(spark: SparkSession, d: str) -> DataFrame:
    return trees.edge_classes(_texts(spark, d), K)


@query("st_entropy", KIDS + """ select item_id, lo, hi, round(sum(-s * log2(s)), 9) + 0.0 entropy
  from (select item_id, lo, hi, (c_hi - c_lo + 1)::double / (hi - lo + 1) s from kid) group by all""")
def st_entropy(spark: SparkSession, d: str) -> DataFrame:
    return trees.node_entropy(_texts(spark, d), K).withColumn("entropy", F.round("entropy", 9))


_ASKED = f"q as (select unnest([{', '.join(repr(p) for p in PATTERNS)}]) pattern), st as (select pattern, unnest(range(1, length(pattern) + 1)) step from q)"
_REV = """, rv as (select item_id, string_agg(c, '' order by i desc) t from (select item_id, i, substr(text, i, 1) c from benchmark, lateral (select unnest(range(1, length(text) + 1)) i)) group by 1),
  rs as (select item_id, unnest(range(0, length(t))) p, t from rv),
  rx as (select item_id, substr(t, p + 1) sfx, row_number() over (partition by item_id order by substr(t, p + 1)) - 1 sa_rank from rs)"""


def _search(way: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return trees.search(_texts(spark, d), PATTERNS, K, way)

    return run


query("search_backward", SX + f", {_ASKED} select item_id, pattern, step, min(sa_rank) lo, max(sa_rank) hi from sx join st on starts_with(sfx, right(pattern, step)) group by all")(_search("backward"))
query("search_forward", SX + f", {_ASKED} select item_id, pattern, step, min(sa_rank) lo, max(sa_rank) hi from sx join st on starts_with(sfx, left(pattern, step)) group by all")(_search("forward"))
query("search_both", SX + _REV + f""", {_ASKED},
  part as (select pattern, step, case when length(pattern) // 2 + step <= length(pattern) then substr(pattern, length(pattern) // 2 + 1, step) else right(pattern, step) end w from st),
  fw as (select item_id, pattern, step, min(sa_rank) lo, max(sa_rank) hi from sx join part on starts_with(sfx, w) group by all),
  bw as (select item_id, pattern, step, min(sa_rank) r_lo, max(sa_rank) r_hi from rx join part on starts_with(sfx, reverse(w)) group by all)
  select * from fw join bw using (item_id, pattern, step)""")(_search("both"))


_PARENS = NODES + """, o as (
  select item_id, lo * 2 a, -hi b, true as open, lo, hi from nd union all select item_id, hi * 2 + 1, -lo, false, lo, hi from nd),
  r as (select *, row_number() over (partition by item_id order by a, b) - 1 i from o),
  m as (select x.item_id, x.i, y.i mate, x.lo, x.hi, x.open from r x join r y on y.item_id = x.item_id and y.lo = x.lo and y.hi = x.hi and y.open <> x.open)"""


def _parens(spark: SparkSession, d: str) -> DataFrame:
    """item_id, i, open: the parentheses that a walk over the inner nodes of each tree writes."""
    nodes = sx.tree_nodes(_table(spark, d), K)
    ends = nodes.select(*K, F.explode(F.array(F.struct((F.col("lo") * 2).alias("a"), (-F.col("hi")).alias("b"), F.lit(True).alias("open")), F.struct((F.col("hi") * 2 + 1).alias("a"), (-F.col("lo")).alias("b"), F.lit(False).alias("open")))).alias("e"))
    return ends.select(*K, (F.row_number().over(Window.partitionBy(*K).orderBy("e.a", "e.b")) - 1).cast("long").alias("i"), "e.open")


@query("bp_enclose", _PARENS + """ select x.item_id, x.i, (select count(*) from r where r.item_id = x.item_id and r.i <= x.i and r.open) - (select count(*) from r where r.item_id = x.item_id and r.i <= x.i and not r.open) excess,
  case when x.open then max(u.i) else x.mate end enclose
  from m x left join m u on u.item_id = x.item_id and u.open and u.i < x.i and u.mate > greatest(x.i, x.mate) group by x.item_id, x.i, x.open, x.mate""")
def bp_enclose(spark: SparkSession, d: str) -> DataFrame:
    return trees.enclosing(sq.match_parentheses(_parens(spark, d), K), K)


@query("bp_enclose_pairs", _PARENS + """, ops as (select *, lag(i, 2) over w i2, lag(mate, 2) over w mate2 from m where open window w as (partition by item_id order by i)),
  pr as (select item_id, i2 i, mate2, i j, mate from ops where mate2 < i),
  up as (select pr.item_id, pr.i, pr.j, u.i k, u.i < pr.i around from pr join m u on u.item_id = pr.item_id and u.open and u.i < pr.j and u.mate > pr.mate)
  select pr.item_id, pr.i, pr.j, min(case when not around then k end) rr_enclose, max(case when around then k end) double_enclose
  from pr left join up using (item_id, i, j) group by all""")
def bp_enclose_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For every opening and the one two openings before, if that pair has ended: what encloses one and both."""
    parens = _parens(spark, d)
    bits = parens.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("i", "open"))).alias("x")).select(*K, F.array_join(F.transform("x", lambda x: F.when(x["open"], "(").otherwise(")")), "").alias("parens"))
    ops = sq.match_parentheses(parens, K).filter("i < mate")
    w = Window.partitionBy(*K).orderBy("i")
    pairs = ops.select(*K, F.lag("i", 2).over(w).alias("i2"), F.lag("mate", 2).over(w).alias("mate2"), "i").filter("mate2 < i").select(*K, F.col("i2").alias("i"), F.col("i").alias("j"))
    return trees.enclosing_pairs(bits, pairs, K)


@query("louds_tree", NODES + """, up as (
  select a.item_id, a.lo, a.hi, count(b.lo) lvl, arg_max(b.lo, b.depth) p_lo, arg_max(b.hi, b.depth) p_hi
  from nd a left join nd b on b.item_id = a.item_id and b.lo <= a.lo and b.hi >= a.hi and b.depth < a.depth group by all),
  no as (select *, row_number() over (partition by item_id order by lvl, lo) - 1 v from up)
  select x.item_id, x.v, count(c.v) degree, p.v parent, min(c.v) first_child
  from no x left join no p on p.item_id = x.item_id and p.lo = x.p_lo and p.hi = x.p_hi
  left join no c on c.item_id = x.item_id and c.p_lo = x.lo and c.p_hi = x.hi group by x.item_id, x.v, p.v""")
def louds_tree(spark: SparkSession, d: str) -> DataFrame:
    """The trees of inner nodes as bits, level by level, and degree, parent and first child read back from them."""
    nodes = sx.tree_nodes(_table(spark, d), K)
    deep = nodes.join(sx.node_depths(nodes, K), [*K, "lo", "hi"])
    node = F.struct("lo", "hi")
    rows = deep.select(*K, node.alias("node"), F.when(F.col("parent_lo") >= 0, F.struct(F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi"))).alias("parent"), F.struct("node_depth", "lo").alias("rank"))
    return trees.louds_nodes(trees.louds(rows, K), K)
