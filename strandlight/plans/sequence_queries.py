"""Sequence, permutation, point and graph queries: the users of all events, all line items, all customers as askers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators import sequences as sq
from strandlight.operators import suffixes as sx
from strandlight.plans.ms_queries import CODE, KEYS, _bit_rows
from strandlight.plans.registry import query, read
from strandlight.plans.suffix_queries import LCP, NODES

SQL = """with seq as (select event_id i, user_id c from events),
n as (select count(*) n from events),
qs as (
  select c_custkey q, (c_custkey * 7) % n i, c_custkey % 100 c, c_custkey % 3 + 1 k,
         (c_custkey * 7) % n lb, (c_custkey * 7) % n + 64 rb, c_nationkey grp from customer, n),
met as (select qs.*, seq.i p, seq.c sym from qs join seq on seq.i >= lb and seq.i < rb) """


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("c"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("c_custkey") * 7 % F.col("n")
    return read(spark, d, "customer").crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("q"), at.alias("i"), (F.col("c_custkey") % 100).alias("c"), (F.col("c_custkey") % 3 + 1).alias("k"), at.alias("lb"), (at + 64).alias("rb"), F.col("c_nationkey").alias("grp"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).drop("i")


@query("seq_access", SQL + " select q, qs.i, seq.c sym from qs join seq using (i)")
def seq_access(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).select("q", "i").join(_seq(spark, d).withColumnRenamed("c", "sym"), "i")


@query("seq_rank", SQL + " select q, qs.i, qs.c, count(seq.i) rank from qs left join seq on seq.c = qs.c and seq.i < qs.i group by all")
def seq_rank(spark: SparkSession, d: str) -> DataFrame:
    return sq.rank_at(_seq(spark, d), _asks(spark, d).select("q", "i", "c"))


@query("seq_select", SQL + ", r as (select *, row_number() over (partition by c order by i) k from seq) select q, qs.c, qs.k, r.i pos from qs left join r on r.c = qs.c and r.k = qs.k")
def seq_select(spark: SparkSession, d: str) -> DataFrame:
    return sq.select_kth(_seq(spark, d), _asks(spark, d).select("q", "c", "k"))


@query("seq_inverse_select", SQL + " select i, c, row_number() over (partition by c order by i) - 1 rank from seq")
def seq_inverse_select(spark: SparkSession, d: str) -> DataFrame:
    return sq.ranks(_seq(spark, d))


@query("seq_double_rank", SQL + " select q, lb, rb, qs.c, count(*) filter (where seq.i < lb)::bigint rank_lb, count(*) filter (where seq.i < rb)::bigint rank_rb from qs left join seq on seq.c = qs.c group by all")
def seq_double_rank(spark: SparkSession, d: str) -> DataFrame:
    asks = _ranges(spark, d).select("q", "lb", "rb", "c")
    return sq.rank_at(_seq(spark, d), sq.rank_at(_seq(spark, d), asks, "lb", "rank_lb"), "rb", "rank_rb")


@query("seq_rank_and_fail", SQL + """, x as (select q, lb, rb, qs.c, count(*) filter (where seq.i < lb)::bigint rank_lb, count(*) filter (where seq.i < rb)::bigint rank_rb from qs left join seq on seq.c = qs.c group by all)
  select *, rank_lb = rank_rb failed from x""")
def seq_rank_and_fail(spark: SparkSession, d: str) -> DataFrame:
    """Both ranks, and whether the range has no such symbol."""
    asks = _ranges(spark, d).select("q", "lb", "rb", "c")
    return sq.rank_at(_seq(spark, d), sq.rank_at(_seq(spark, d), asks, "lb", "rank_lb"), "rb", "rank_rb").withColumn("failed", F.col("rank_lb") == F.col("rank_rb"))


@query("seq_rank_and_check", SQL + """, x as (select q, qs.i, qs.c, count(seq.i) rank from qs left join seq on seq.c = qs.c and seq.i < qs.i group by all)
  select x.*, seq.c = x.c there from x join seq using (i)""")
def seq_rank_and_check(spark: SparkSession, d: str) -> DataFrame:
    """The rank at a place, and whether the symbol stands there."""
    ranked = sq.rank_at(_seq(spark, d), _asks(spark, d).select("q", "i", "c"))
    return ranked.join(_seq(spark, d).withColumnRenamed("c", "sym"), "i").withColumn("there", F.col("sym") == F.col("c")).drop("sym")


@query("seq_select_at_dist", SQL + ", r as (select q, qs.i, qs.c, k, seq.i pos, row_number() over (partition by q order by seq.i) n from qs join seq on seq.c = qs.c and seq.i >= qs.i) select qs.q, qs.i, qs.c, qs.k, r.pos from qs left join r on r.q = qs.q and r.n = qs.k")
def seq_select_at_dist(spark: SparkSession, d: str) -> DataFrame:
    return sq.select_after(_seq(spark, d), _asks(spark, d).select("q", "i", "c", "k"))


@query("seq_interval_symbols", SQL + ", r as (select i, c, row_number() over (partition by c order by i) - 1 rank from seq) select q, sym, count(*) n, min(rank) rank_lb, max(rank) + 1 rank_rb from met join r on r.i = met.p group by all")
def seq_interval_symbols(spark: SparkSession, d: str) -> DataFrame:
    return sq.interval_symbols(_seq(spark, d), _ranges(spark, d).select("q", "lb", "rb"))


@query("seq_lex_count", SQL + " select qs.q, count(*) filter (where sym < qs.c)::bigint smaller, count(*) filter (where sym > qs.c)::bigint greater, count(*) filter (where sym = qs.c)::bigint equal from qs left join met using (q) group by qs.q")
def seq_lex_count(spark: SparkSession, d: str) -> DataFrame:
    return sq.lex_count(_seq(spark, d), _ranges(spark, d))


@query("seq_quantile", SQL + ", o as (select q, k, sym, row_number() over (partition by q order by sym) - 1 r, count(*) over (partition by q, sym) n from met) select q, sym as value, n from o where r = k")
def seq_quantile(spark: SparkSession, d: str) -> DataFrame:
    return sq.quantile(_seq(spark, d), _ranges(spark, d))


@query("seq_intersect", SQL + " select grp, sym, count(distinct q) n_ranges from met group by all having count(distinct q) >= 3")
def seq_intersect(spark: SparkSession, d: str) -> DataFrame:
    return sq.intersect(_seq(spark, d), _ranges(spark, d), 3)


@query("seq_pred_succ", SQL + " select qs.q, max(case when sym <= qs.c then sym end) pred, min(case when sym >= qs.c then sym end) succ from qs left join met using (q) group by qs.q")
def seq_pred_succ(spark: SparkSession, d: str) -> DataFrame:
    return sq.pred_succ(_seq(spark, d), _ranges(spark, d))


@query("seq_unique_values", SQL + " select distinct q, sym from met where sym between c and c + 20")
def seq_unique_values(spark: SparkSession, d: str) -> DataFrame:
    return sq.unique_values(_seq(spark, d), _ranges(spark, d), F.col("c"), F.col("c") + 20)


@query("seq_range2d", SQL + " select qs.q, count(*) filter (where sym between qs.c and qs.c + 20)::bigint n from qs left join met using (q) group by qs.q")
def seq_range2d(spark: SparkSession, d: str) -> DataFrame:
    return sq.count_2d(_seq(spark, d), _ranges(spark, d), F.col("c"), F.col("c") + 20)


@query("rmq", SQL + " select qs.q, arg_min(p, sym * 10000000 + p) min_pos, min(sym) min_value, arg_max(p, sym * 10000000 - p) max_pos, max(sym) max_value from qs left join met using (q) group by qs.q")
def rmq(spark: SparkSession, d: str) -> DataFrame:
    return sq.range_extremes(_seq(spark, d), _ranges(spark, d))


@query("inverse_perm", "select (p_partkey * 7) % (select count(*) from part) i, p_partkey inv from part")
def inverse_perm(spark: SparkSession, d: str) -> DataFrame:
    """Part keys times seven, modulo their number, is a permutation of them."""
    part = read(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    return sq.inverse_permutation(part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("i"), (F.col("p_partkey") * 7 % F.col("n")).alias("p")))


@query("nsv_psv", LCP + """ select a.item_id, a.sa_rank,
  coalesce(max(case when b.sa_rank < a.sa_rank then b.sa_rank end), -1) psv, min(case when b.sa_rank > a.sa_rank then b.sa_rank end) nsv
  from lx a left join lx b on b.item_id = a.item_id and b.lcp < a.lcp group by all""")
def nsv_psv(spark: SparkSession, d: str) -> DataFrame:
    table = sx.suffix_table(read(spark, d, "benchmark"), ["item_id"])
    return sq.smaller_values(table, ["item_id"], "sa_rank", "lcp")


@query("bp_match", NODES + """, o as (
  select item_id, lo * 2 a, -hi b, true as open, lo, hi from nd union all select item_id, hi * 2 + 1, -lo, false, lo, hi from nd),
  r as (select *, row_number() over (partition by item_id order by a, b) - 1 i from o),
  m as (select x.item_id, x.i, y.i mate, x.lo, x.hi from r x join r y on y.item_id = x.item_id and y.lo = x.lo and y.hi = x.hi and y.open <> x.open),
  lv as (select m.item_id, m.lo, m.hi, count(*) as lev from nd m join nd u on u.item_id = m.item_id and u.lo <= m.lo and u.hi >= m.hi group by all)
  select m.item_id, m.i, m.mate, lv.lev as level from m join lv using (item_id, lo, hi)""")
def bp_match(spark: SparkSession, d: str) -> DataFrame:
    """The mates of the parentheses that a walk over each suffix tree writes."""
    from pyspark.sql import Window

    nodes = sx.tree_nodes(sx.suffix_table(read(spark, d, "benchmark"), ["item_id"]), ["item_id"])
    ends = nodes.select("item_id", F.explode(F.array(F.struct((F.col("lo") * 2).alias("a"), (-F.col("hi")).alias("b"), F.lit(True).alias("open")), F.struct((F.col("hi") * 2 + 1).alias("a"), (-F.col("lo")).alias("b"), F.lit(False).alias("open")))).alias("e"))
    rows = ends.select("item_id", (F.row_number().over(Window.partitionBy("item_id").orderBy("e.a", "e.b")) - 1).cast("long").alias("i"), "e.open")
    return sq.match_parentheses(rows, ["item_id"])


@query("bv_rank_select", CODE + """ select conv_id, turn, bit_pos, bit, (sum(bit) over w - bit)::bigint rank1,
  case when bit = 1 then sum(bit) over w end::bigint select_no from b window w as (partition by conv_id, turn order by bit_pos)""")
def bv_rank_select(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ones = F.sum("bit").over(Window.partitionBy(*KEYS).orderBy("bit_pos"))
    return _bit_rows(spark, d).select(*KEYS, "bit_pos", "bit", (ones - F.col("bit")).alias("rank1"), F.when(F.col("bit") == 1, ones).alias("select_no"))


@query("bv_prev_next", CODE + """ select conv_id, turn, bit_pos, max(case when bit = 1 then bit_pos end) over (partition by conv_id, turn order by bit_pos) prev_one,
  min(case when bit = 1 then bit_pos end) over (partition by conv_id, turn order by bit_pos rows between current row and unbounded following) next_one from b""")
def bv_prev_next(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    one = F.when(F.col("bit") == 1, F.col("bit_pos"))
    by = Window.partitionBy(*KEYS)
    return _bit_rows(spark, d).select(*KEYS, "bit_pos", F.max(one).over(by.orderBy("bit_pos")).alias("prev_one"), F.min(one).over(by.orderBy(F.desc("bit_pos"))).alias("next_one"))


@query("graph_neighbors", "select l_partkey, count(distinct l_suppkey) n, min(l_suppkey) least, max(l_suppkey) most from lineitem group by 1")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return sq.neighbours(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("graph_reverse_neighbors", "select l_suppkey, count(distinct l_partkey) n, min(l_partkey) least, max(l_partkey) most from lineitem group by 1")
def graph_reverse_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return sq.neighbours(read(spark, d, "lineitem"), "l_suppkey", "l_partkey")


_POINTS = """with pt as (select l_partkey x, l_suppkey y, l_quantity w, l_orderkey * 10 + l_linenumber id from lineitem),
box as (select n_nationkey q, n_nationkey * 5 x0, n_nationkey * 5 + 90 x1, n_nationkey y0, n_nationkey + 30 y1 from nation),
met as (select q, x, y, w, id from box join pt on x between x0 and x1 and y between y0 and y1) """


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select(k.alias("q"), (k * 5).alias("x0"), (k * 5 + 90).alias("x1"), k.alias("y0"), (k + 30).alias("y1"))


@query("points_topk", _POINTS + " select q, (row_number() over (partition by q order by w desc, id, x, y))::int rank, x, y, w, id from met qualify rank <= 5")
def points_topk(spark: SparkSession, d: str) -> DataFrame:
    return sq.heaviest(_points(spark, d), _boxes(spark, d), 5)


@query("points_count", _POINTS + " select q, count(*) n from met group by 1")
def points_count(spark: SparkSession, d: str) -> DataFrame:
    return sq.in_rectangles(_points(spark, d), _boxes(spark, d)).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query("points_range3d", _POINTS + " select * from met where w between 10 and 20")
def points_range3d(spark: SparkSession, d: str) -> DataFrame:
    return sq.in_rectangles(_points(spark, d), _boxes(spark, d)).filter("w between 10 and 20").select("q", "x", "y", "w", "id")
