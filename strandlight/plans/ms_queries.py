"""Matching statistics of all conversation turns against all benchmark passages, and what is asked of the vector."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators import blocks, matching, ranges, vectors
from strandlight.operators.generate import draw
from strandlight.plans.registry import query, read
from strandlight.sources import stored

KEYS = ["conv_id", "turn"]

_STEPS = "".join(
    f""",
m{k + 1} as (
  select conv_id, turn, t, pos, case when w is not null then ms + {step} else ms end ms
  from m{k} left join sub on w = substr(t, pos + 1, ms + {step}) and pos + ms + {step} <= length(t))"""
    for k, step in enumerate((1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1))
)
#: ms(conv_id, turn, pos, ms): whether a prefix occurs only falls with its length, so lengths are found by bisection.
MS = f"""with sub as (
  select distinct substr(text, i, l) w from benchmark, lateral (select unnest(range(1, length(text) + 1)) i),
         lateral (select unnest(range(1, length(text) - i + 2)) l)),
m0 as (select conv_id, turn, text t, unnest(range(0, length(text))) pos, 0 ms from conversations){_STEPS},
ms as (select conv_id, turn, pos, ms::int ms from m11)"""
#: zero(…, n_zeros) and code of each position
CODE = MS + """,
z as (select *, (ms - lag(ms, 1, 1) over (partition by conv_id, turn order by pos) + 1)::int n_zeros from ms),
bits as (
  select conv_id, turn, string_agg(repeat('0', n_zeros) || '1', '' order by pos)
         || case when arg_max(ms, pos) = 0 then '0' else '' end bits
  from z group by conv_id, turn),
b as (select conv_id, turn, unnest(range(0, length(bits))) bit_pos, unnest(string_split(bits, ''))::int bit from bits)"""
FREQ = MS + """,
occ as (
  select substr(text, i, l) w, count(*) n from benchmark, lateral (select unnest(range(1, length(text) + 1)) i),
         lateral (select unnest(range(1, length(text) - i + 2)) l)
  where l <= (select max(ms) from ms) group by 1),
f as (
  select m.conv_id, m.turn, m.pos, m.ms,
         case when m.ms = 0 then (select sum(length(text) + 1) from benchmark) else o.n end::bigint freq, c.text t
  from ms m join conversations c using (conv_id, turn) left join occ o on o.w = substr(c.text, m.pos + 1, m.ms))"""


def _ms(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    return matching.ms_build(read(spark, d, "benchmark"), read(spark, d, "conversations"), KEYS, strategy=strategy)


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return matching.ms_frequency(read(spark, d, "benchmark"), read(spark, d, "conversations"), KEYS)


def _bits(spark: SparkSession, d: str) -> DataFrame:
    return vectors.encode_arrays(matching.ms_arrays(read(spark, d, "benchmark"), read(spark, d, "conversations"), KEYS), KEYS)


def _bit_rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors.bit_rows(_bits(spark, d), KEYS)


@query("ms_build", MS + " select * from ms")
def ms_build(spark: SparkSession, d: str) -> DataFrame:
    return _ms(spark, d)


@query("ms_seed", MS + " select * from ms")
def ms_seed(spark: SparkSession, d: str) -> DataFrame:
    return _ms(spark, d, "seed")


@query("ms_naive", MS + " select * from ms")
def ms_naive(spark: SparkSession, d: str) -> DataFrame:
    return _ms(spark, d, "prefix")


@query(
    "ms_cross",
    """with sub as (
  select distinct r_regionkey, substr(r_name, i, l) w from region, lateral (select unnest(range(1, length(r_name) + 1)) i),
         lateral (select unnest(range(1, length(r_name) - i + 2)) l)),
q as (select n_nationkey, n_name, unnest(range(0, length(n_name))) pos from nation),
g as (select r_regionkey text_id, n_nationkey query_id, pos, n_name from region, q)
select text_id, query_id, pos, coalesce(max(length(w)), 0)::int ms
from g left join sub on r_regionkey = text_id and w = substr(n_name, pos + 1, length(w)) group by all""",
)
def ms_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every text with every query: pairs are keys of their own."""
    texts = read(spark, d, "region").select(F.col("r_regionkey").alias("text_id"), F.col("r_name").alias("s"))
    queries = read(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("t"))
    return matching.ms_pairs(texts, queries)


@query("ms_documents", None)
def ms_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every whole document: how much of it the benchmark passages cover, from the vector of its matches."""
    found = matching.ms_vectors(read(spark, d, "benchmark"), read(spark, d, "documents"), ["doc_id"])
    total = F.aggregate("ms", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", F.size("ms").alias("n"), F.array_max("ms").alias("max_ms"), total.alias("sum_ms"))


@query("ms_encode", CODE + " select * from bits")
def ms_encode(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d)


@query("ms_decode", MS + " select * from ms")
def ms_decode(spark: SparkSession, d: str) -> DataFrame:
    return vectors.decode(_bits(spark, d), KEYS)


@query("ms_runs", MS + " select conv_id, turn, pos, coalesce((ms = lag(ms) over (partition by conv_id, turn order by pos) - 1)::int, 0) runs from ms")
def ms_runs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.runs(_ms(spark, d), KEYS)


@query("ms_frequency", FREQ + " select conv_id, turn, pos, ms, freq from f")
def ms_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d)


@query("ms_runs_freq", FREQ + """ select conv_id, turn, pos,
  coalesce((ms = lag(ms) over w - 1 and freq = lag(freq) over w)::int, 0) runs_freq from f window w as (partition by conv_id, turn order by pos)""")
def ms_runs_freq(spark: SparkSession, d: str) -> DataFrame:
    return vectors.runs_with_frequency(_freq(spark, d), KEYS)


@query("ms_print_freq", FREQ + " select conv_id, turn, string_agg(freq::varchar, ' ' order by pos) line from f group by all")
def ms_print_freq(spark: SparkSession, d: str) -> DataFrame:
    return vectors.printed(_freq(spark, d), KEYS, "freq")


@query("ms_table", FREQ + """ select conv_id, turn, pos, substr(t, pos + 1, 1) symbol, ms,
  (ms - lag(ms, 1, 1) over w + 1)::int n_zeros, repeat('0', (ms - lag(ms, 1, 1) over w + 1)::int) || '1' bits,
  coalesce((ms = lag(ms) over w - 1)::int, 0) runs, substr(t, pos + 1, ms) matched, freq,
  coalesce((ms = lag(ms) over w - 1 and freq = lag(freq) over w)::int, 0) runs_freq
  from f window w as (partition by conv_id, turn order by pos)""")
def ms_table(spark: SparkSession, d: str) -> DataFrame:
    return vectors.full_table(_freq(spark, d), read(spark, d, "conversations"), KEYS)


@query("ms_avg", MS + " select conv_id, turn, avg(ms) avg_ms from ms group by all")
def ms_avg(spark: SparkSession, d: str) -> DataFrame:
    return vectors.average(_ms(spark, d), KEYS)


@query("ms_composition", CODE + " select conv_id, turn, count(*) n_bits, sum(1 - bit)::bigint n_zeros, sum(bit)::bigint n_ones from b group by all")
def ms_composition(spark: SparkSession, d: str) -> DataFrame:
    return vectors.composition(_bits(spark, d), KEYS)


@query("ms_extremes", MS + " select conv_id, turn, max(ms) max_ms, bool_or(ms <= 3) some_at_most from ms group by all")
def ms_extremes(spark: SparkSession, d: str) -> DataFrame:
    return vectors.extremes(_ms(spark, d), KEYS, 3)


@query("ms_check", CODE + """ select z.conv_id, z.turn, count_if(n_zeros < 0)::bigint falls, count_if(ms < 0)::bigint negative,
  (any_value(length(bits)) <> 2 * count(*))::int bad_length, (any_value(length(replace(bits, '0', ''))) <> count(*))::int bad_ones
  from z join bits using (conv_id, turn) group by all""")
def ms_check(spark: SparkSession, d: str) -> DataFrame:
    ms = _ms(spark, d)
    return vectors.check(ms, vectors.encode(ms, KEYS), KEYS)


@query("ms_stats", CODE + """ select conv_id, turn, length(x)::bigint size, length(replace(x, '1', ''))::bigint zeros, length(replace(x, '0', ''))::bigint ones
  from (select conv_id, turn, substr(bits, 3, 50) x from bits)""")
def ms_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.stats(_bits(spark, d), KEYS, 2, 50)


@query("ms_bits_slice", CODE + " select conv_id, turn, substr(bits, 5, 24) bits from bits")
def ms_bits_slice(spark: SparkSession, d: str) -> DataFrame:
    return vectors.slice_bits(_bits(spark, d), KEYS, 4, 24)


@query("ms_print", MS + " select conv_id, turn, string_agg(ms::varchar, ' ' order by pos) line from ms group by all")
def ms_print(spark: SparkSession, d: str) -> DataFrame:
    return vectors.printed(_ms(spark, d), KEYS)


@query("ms_at", MS + ", p as (select conv_id, turn, unnest([0, 5, 1000000]) pos from conversations) select conv_id, turn, pos::bigint pos, ms from p left join ms using (conv_id, turn, pos)")
def ms_at(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "conversations").select(*KEYS, F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 5, 1_000_000)))).alias("pos"))
    return vectors.value_at(_ms(spark, d), points, KEYS)


#: Seven ranges of each vector: whole, first, last, inside a block, over blocks, clamped, empty.
_RANGES = """, r as (
  select conv_id, turn, n, unnest([0, 1, 2, 3, 4, 5, 6]) range_id, unnest([0, 0, n - 1, 5, 3, n // 2, 4]) from_idx,
         unnest([n, 1, n, 7, 3 + n // 3, 2 * n, 4]) to_idx
  from (select conv_id, turn, length(text)::bigint n from conversations))"""
_SUM = _RANGES + " select r.conv_id, r.turn, range_id::int range_id, from_idx, to_idx, sum(ms)::bigint sum from r left join ms on ms.conv_id = r.conv_id and ms.turn = r.turn and pos >= from_idx and pos < to_idx group by all"
_MAX = _RANGES + " select r.conv_id, r.turn, range_id::int range_id, from_idx, to_idx, arg_max(pos, ms * 1000000 - pos) max_index, max(ms)::bigint max_value from r left join ms on ms.conv_id = r.conv_id and ms.turn = r.turn and pos >= from_idx and pos < to_idx group by all"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    pairs = [(F.lit(0), n), (F.lit(0), F.lit(1)), (n - 1, n), (F.lit(5), F.lit(7)), (F.lit(3), 3 + F.floor(n / 3)), (F.floor(n / 2), 2 * n), (F.lit(4), F.lit(4))]
    each = F.array(*(F.struct(F.lit(i).alias("id"), a.cast("long").alias("a"), z.cast("long").alias("z")) for i, (a, z) in enumerate(pairs)))
    return read(spark, d, "conversations").select(*KEYS, F.length("text").cast("long").alias("n")).select(*KEYS, F.explode(each).alias("r")).select(*KEYS, F.col("r.id").alias("range_id"), F.col("r.a").alias("from_idx"), F.col("r.z").alias("to_idx"))


def _range_query(op: str, algorithm: str, block: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ms = _ms(spark, d)
        if block:  # the vector is read several times
            ms = stored.store(ms, f"{stored.shared_folder(spark)}/ms-{uuid.uuid4().hex}", [*KEYS, "pos"])
        out = ranges.answer(ms, _ranges(spark, d), KEYS, op, algorithm, block)
        return out.withColumn("max_value", F.col("max_value").cast("long")) if op == "max" else out

    return run


for _name, _args in {"range_sum": ("sum", "scan", 0), "range_sum_runs": ("sum", "runs", 0), "range_sum_indexed": ("sum", "scan", 4), "range_max": ("max", "scan", 0), "range_max_runs": ("max", "runs", 0), "range_max_indexed": ("max", "scan", 4)}.items():
    query(_name, MS + (_SUM if _args[0] == "sum" else _MAX))(_range_query(*_args))


@query("range_index", MS + " select conv_id, turn, (pos // 4)::bigint block, sum(ms)::bigint sum, max(ms) ms, arg_max(pos, ms * 1000000 - pos) pos from ms group by conv_id, turn, pos // 4")
def range_index(spark: SparkSession, d: str) -> DataFrame:
    return ranges.block_index(_ms(spark, d), KEYS, 4)


_START = "('0x' || substr(md5('123:' || k || ':' || conv_id || ':' || turn), 1, 8))::bigint"


@query("range_profile", MS + f""", r as (
  select conv_id, turn, k, {_START} % (n - 31) a from (select conv_id, turn, unnest(range(0, 8)) k, length(text) n from conversations where length(text) >= 32))
  select r.conv_id, r.turn, k::int range_id, a::bigint from_idx, (a + 32)::bigint to_idx, sum(ms)::bigint sum
  from r join ms on ms.conv_id = r.conv_id and ms.turn = r.turn and pos >= a and pos < a + 32 group by all""")
def range_profile(spark: SparkSession, d: str) -> DataFrame:
    """Eight ranges of 32 positions in each vector that has as many, at random starts by the seed 123."""
    at = draw(123, F.col("range_id"), F.col("conv_id"), F.col("turn")) % (F.col("n") - 31)
    rows = read(spark, d, "conversations").select(*KEYS, F.length("text").alias("n")).filter("n >= 32").withColumn("range_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return ranges.range_sum_indexed(ranges.prefix_sums(_ms(spark, d), KEYS), rows.select(*KEYS, "range_id", at.cast("long").alias("from_idx"), (at + 32).cast("long").alias("to_idx")), KEYS)


@query("split_fixed", CODE + " select conv_id, turn, bit_pos // 64 block, min(bit_pos) as start, max(bit_pos) + 1 as \"end\", sum(bit)::bigint n_ones from b group by all")
def split_fixed(spark: SparkSession, d: str) -> DataFrame:
    return blocks.split_fixed(_bit_rows(spark, d), KEYS, 64)


@query("split_ones", CODE + """, c as (select *, ((sum(bit) over (partition by conv_id, turn order by bit_pos) - bit) // 5)::bigint block from b)
  select conv_id, turn, block, min(bit_pos) as start, max(bit_pos) + 1 as "end", sum(bit)::bigint n_ones from c group by all having sum(bit) = 5""")
def split_ones(spark: SparkSession, d: str) -> DataFrame:
    return blocks.split_ones(_bit_rows(spark, d), KEYS, 5)


PAIRS = CODE + """,
h as (select *, (bit = 0 and lag(bit, 1, 1) over (partition by conv_id, turn order by bit_pos) = 1)::int head from b),
g as (select *, sum(head) over (partition by conv_id, turn order by bit_pos) p from h),
pairs as (
  select conv_id, turn, (p - min(p) over (partition by conv_id, turn))::bigint pair, start, zeros, ones
  from (select conv_id, turn, p, min(bit_pos) as start, sum(1 - bit)::bigint zeros, sum(bit)::bigint ones from g group by all))"""


@query("run_pairs", PAIRS + " select * from pairs")
def run_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.pairs_of_bits(_bits(spark, d), KEYS)


@query("split_patterns", PAIRS + " select conv_id, turn, start, start + zeros + ones as \"end\", ones n_ones from pairs where zeros + ones >= 8")
def split_patterns(spark: SparkSession, d: str) -> DataFrame:
    return blocks.split_patterns(_bit_rows(spark, d), KEYS, 8)


@query("run_hist", PAIRS + """ select conv_id, turn, bit, length, count(*) n from (
  select conv_id, turn, 0 bit, zeros length from pairs union all select conv_id, turn, 1, ones from pairs) where length > 0 group by all""")
def run_hist(spark: SparkSession, d: str) -> DataFrame:
    return blocks.run_histogram(_bit_rows(spark, d), KEYS)
