"""Trees, repeats, indexes and vectors that are stored and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators import ranges, vectors
from strandlight.operators import suffixes as sx
from strandlight.plans.ms_queries import _MAX, _SUM, CODE, FREQ, KEYS, MS, _bits, _freq, _ms, _ranges
from strandlight.plans.registry import query
from strandlight.plans.suffix_queries import GRAMS, NODES, K, _texts
from strandlight.sources import stored


def _folder(spark: SparkSession, name: str) -> str:
    return f"{stored.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_TREE = """select item_id, {way} as backwards, lo, hi, depth, coalesce(p_lo, -1) parent_lo, coalesce(p_hi, -1) parent_hi from (
  select a.item_id, a.lo, a.hi, a.depth, arg_max(b.lo, b.depth) p_lo, arg_max(b.hi, b.depth) p_hi
  from nd a left join nd b on b.item_id = a.item_id and b.lo <= a.lo and b.hi >= a.hi and b.depth < a.depth group by all)"""
_BACK = "(select item_id, string_agg(c, '' order by i desc) as text from (select item_id, i, substr(text, i, 1) c from benchmark, lateral (select unnest(range(1, length(text) + 1)) i)) group by 1)"
TOPOLOGY = f"select * from ({NODES} {_TREE.format(way='false')}) union all select * from ({NODES.replace('from benchmark', f'from {_BACK}')} {_TREE.format(way='true')})"


def _topology(spark: SparkSession, d: str) -> DataFrame:
    """The inner nodes of each passage's tree, forwards and backwards."""
    ways = [sx.tree_nodes(sx.suffix_table(_texts(spark, d), K, backwards=b), K).withColumn("backwards", F.lit(b)) for b in (False, True)]
    return ways[0].unionByName(ways[1]).select(*K, "backwards", "lo", "hi", "depth", "parent_lo", "parent_hi")


@query("topology_dump", TOPOLOGY)
def topology_dump(spark: SparkSession, d: str) -> DataFrame:
    return stored.store(_topology(spark, d), _folder(spark, "topology"), K)


@query("topology_load", TOPOLOGY)
def topology_load(spark: SparkSession, d: str) -> DataFrame:
    """Built by the first call, loaded by the second one."""
    path = _folder(spark, "topology")
    stored.load_or_build(spark, path, lambda: _topology(spark, d), K)
    return stored.load_or_build(spark, path, lambda: _topology(spark, d).limit(0), K)


REPEATS = GRAMS + " select item_id, gram, n from r where n_next > 1 and n_prev > 1"


@query("maxrep_dump", REPEATS)
def maxrep_dump(spark: SparkSession, d: str) -> DataFrame:
    return stored.store(sx.maximal_repeats(_texts(spark, d), K), _folder(spark, "maxrep"), K)


@query("maxrep_text", REPEATS)
def maxrep_text(spark: SparkSession, d: str) -> DataFrame:
    """The text form, read back: the gram comes last, so that it may hold a tab; a line feed in it is written as a code."""
    rows = sx.maximal_repeats(_texts(spark, d), K).withColumn("gram", F.url_encode("gram"))
    part = F.split("value", "\t", 3)
    lines = stored.write_lines(rows, _folder(spark, "maxrep-text"), ["item_id", "n", "gram"])
    return lines.select(part[0].cast("long").alias("item_id"), F.url_decode(part[2]).alias("gram"), part[1].cast("long").alias("n"))


@query("maxrep_load", REPEATS)
def maxrep_load(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "maxrep")
    stored.load_or_build(spark, path, lambda: sx.maximal_repeats(_texts(spark, d), K), K)
    return stored.load_or_build(spark, path, lambda: sx.maximal_repeats(_texts(spark, d), K).limit(0), K)


@query("range_index_dump", MS + """, u as (select conv_id, turn, pos // 4 block, ms, pos from ms)
  select conv_id, turn, block::bigint block, sum(ms)::bigint sum, max(ms) ms, arg_max(pos, ms * 1000000 - pos) pos from u group by conv_id, turn, block""")
def range_index_dump(spark: SparkSession, d: str) -> DataFrame:
    return stored.store(ranges.block_index(_ms(spark, d), KEYS, 4), _folder(spark, "range-index"), [*KEYS, "block"])


@query("range_sum_stored", MS + _SUM)
def range_sum_stored(spark: SparkSession, d: str) -> DataFrame:
    """Sums from a stored index of prefix sums."""
    index = stored.store(ranges.prefix_sums(_ms(spark, d), KEYS), _folder(spark, "prefix-sums"), [*KEYS, "pos"])
    return ranges.range_sum_indexed(index, _ranges(spark, d), KEYS)


@query("range_max_stored", MS + _MAX)
def range_max_stored(spark: SparkSession, d: str) -> DataFrame:
    """Maxima from a stored vector; its block index and sparse table are stored with it."""
    ms = stored.store(_ms(spark, d), _folder(spark, "ms"), [*KEYS, "pos"])
    asked = _ranges(spark, d)
    index = stored.store(ranges.block_index(ms, KEYS, 4), _folder(spark, "range-index"), [*KEYS, "block"])
    out = ranges.range_max_indexed(ms, asked, KEYS, 4, index)
    return out.withColumn("max_value", F.col("max_value").cast("long"))


@query("vector_dump", FREQ + """, z as (select *, (ms - lag(ms, 1, 1) over w + 1)::int nz, coalesce((ms = lag(ms) over w - 1)::int, 0) run from f window w as (partition by conv_id, turn order by pos))
  select conv_id, turn, string_agg(repeat('0', nz) || '1', '' order by pos) || case when arg_max(ms, pos) = 0 then '0' else '' end bits,
         string_agg(run::varchar, '' order by pos) runs, string_agg(freq::varchar, ' ' order by pos) freq from z group by conv_id, turn""")
def vector_dump(spark: SparkSession, d: str) -> DataFrame:
    """The three vectors of each turn (matches, runs, frequencies), each stored by itself and read again."""
    freq = stored.store(_freq(spark, d), _folder(spark, "freq"), [*KEYS, "pos"])
    bits = stored.store(vectors.encode(freq.drop("freq"), KEYS), _folder(spark, "ms"), KEYS)
    runs = stored.store(vectors.runs(freq.drop("freq"), KEYS), _folder(spark, "runs"), [*KEYS, "pos"])
    line = lambda df, c, sep: df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", c))).alias("x")).select(*KEYS, F.array_join(F.transform("x", lambda x: x[c].cast("string")), sep).alias(c))
    return bits.select(*KEYS, "bits").join(line(runs, "runs", ""), KEYS).join(line(freq, "freq", " "), KEYS)
