"""Code lengths, recodings and lossy forms of the vectors of all conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.functions import codes
from strandlight.operators import blocks, codecs, lossy
from strandlight.plans.ms_queries import CODE, FREQ, KEYS, MS, PAIRS, _bit_rows, _bits, _freq, _ms
from strandlight.plans.registry import query, read

TAU = 7


def _bl(x: str) -> str:
    return f"length(bin(({x})::bigint))"


def _delta(x: str) -> str:
    return f"({_bl(x)} + 2 * {_bl(_bl(x))} - 2)"


def _nibble(x: str) -> str:
    return f"(4 * ceil({_bl(x)} / 3.0))::bigint"


_PROJECT = "case when ones < zeros then 2 * (zeros - ones) when ones < 2 * zeros then 2 * (ones - zeros) + 1 else ones end"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.pairs_of_bits(_bits(spark, d), KEYS)


@query("codec_rle", PAIRS + f" select conv_id, turn, sum({_delta('zeros + 1')} + {_delta('ones')})::bigint n_bits from pairs where ones > 0 group by all")
def codec_rle(spark: SparkSession, d: str) -> DataFrame:
    return codecs.rle_bits(_pairs(spark, d), KEYS)


@query("codec_delta", CODE + f", o as (select conv_id, turn, bit_pos - lag(bit_pos, 1, -1) over (partition by conv_id, turn order by bit_pos) g from b where bit = 1) select conv_id, turn, sum({_delta('g')})::bigint n_bits from o group by all")
def codec_delta(spark: SparkSession, d: str) -> DataFrame:
    return codecs.gap_bits(_bit_rows(spark, d), KEYS)


@query("codec_nibble", PAIRS + f" select conv_id, turn, sum({_nibble('zeros + 1')} + {_nibble('ones')})::bigint n_bits from pairs where ones > 0 group by all")
def codec_nibble(spark: SparkSession, d: str) -> DataFrame:
    return codecs.nibble_bits(_pairs(spark, d), KEYS)


@query("codec_corr", PAIRS + f" select conv_id, turn, sum({_delta('zeros + 1')} + {_delta(_PROJECT)})::bigint n_bits from pairs where ones > 0 group by all")
def codec_corr(spark: SparkSession, d: str) -> DataFrame:
    return codecs.recoded_bits(_pairs(spark, d), KEYS)


@query("lossy_project", PAIRS + f" select conv_id, turn, pair, ({_PROJECT})::bigint code from pairs where zeros > 0 and ones > 0")
def lossy_project(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).filter("zeros > 0 and ones > 0").select(*KEYS, "pair", codes.project(F.col("zeros"), F.col("ones")).cast("long").alias("code"))


@query("lossy_cost", PAIRS + f" select conv_id, turn, sum({_delta('zeros')} + {_delta(_PROJECT)})::bigint diff, sum({_delta('zeros')} + {_delta('ones')})::bigint plain from pairs where zeros > 0 and ones > 0 group by all")
def lossy_cost(spark: SparkSession, d: str) -> DataFrame:
    z, o = F.col("zeros"), F.col("ones")
    pairs = _pairs(spark, d).filter("zeros > 0 and ones > 0")
    return pairs.groupBy(*KEYS).agg(F.sum(codes.delta_length(z) + codes.delta_length(codes.project(z, o))).cast("long").alias("diff"), F.sum(codes.delta_length(z) + codes.delta_length(o)).cast("long").alias("plain"))


@query("lossy_windows", MS + f""", a as (
  select *, ms - lag(ms, 1, 1) over w + 1 z, (ms >= {TAU})::int k, (sum((ms >= {TAU})::int) over w - (ms >= {TAU})::int)::bigint as win,
         sum((ms >= {TAU})::int) over (partition by conv_id, turn) n
  from ms window w as (partition by conv_id, turn order by pos))
  select conv_id, turn, win as "window", min(case when k = 0 then pos end) as first, max(case when k = 0 then pos end) as last, sum(z)::bigint zeros
  from a where win > 0 and win < n group by all having min(case when k = 0 then pos end) is not null""")
def lossy_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows between two values that reach tau; lossy_end_windows has the first and the last one of each turn."""
    return lossy.windows(_ms(spark, d), KEYS, TAU, "inner")


@query("lossy_end_windows", MS + f""", a as (
  select *, ms - lag(ms, 1, 1) over w + 1 z, (ms >= {TAU})::int k, (sum((ms >= {TAU})::int) over w - (ms >= {TAU})::int)::bigint as win,
         sum((ms >= {TAU})::int) over (partition by conv_id, turn) n
  from ms window w as (partition by conv_id, turn order by pos))
  select conv_id, turn, win as "window", min(case when k = 0 then pos end) as first, max(case when k = 0 then pos end) as last,
         (sum(z) + case when win = n then greatest(0, 1 - arg_max(ms, pos)) else 0 end)::bigint zeros
  from a where win = 0 or win = n group by conv_id, turn, win, n having min(case when k = 0 then pos end) is not null""")
def lossy_end_windows(spark: SparkSession, d: str) -> DataFrame:
    return lossy.windows(_ms(spark, d), KEYS, TAU, "ends")


def _lossy(scheme: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lossy.compress(_bits(spark, d), KEYS, TAU, scheme)

    return run


for _name, _scheme in {"lossy_diff": "diff", "lossy_diff_long": "diff_long", "lossy_none": "none"}.items():
    query(_name)(_lossy(_scheme))


@query("lossy_xor")
def lossy_xor(spark: SparkSession, d: str) -> DataFrame:
    return lossy.changed(lossy.compress(_bits(spark, d), KEYS, TAU), KEYS)


@query("block_footprint", CODE + f""", h as (
  select *, bit_pos // 64 block, coalesce((bit <> lag(bit) over (partition by conv_id, turn, bit_pos // 64 order by bit_pos))::int, 1) h from b),
  r as (select *, sum(h) over (partition by conv_id, turn, block order by bit_pos) r from h),
  n as (select conv_id, turn, block, r, count(*) n from r group by all)
  select conv_id, turn, block, sum(n)::bigint plain, sum({_delta('n')})::bigint rle from n group by all""")
def block_footprint(spark: SparkSession, d: str) -> DataFrame:
    return codecs.block_bits(_bit_rows(spark, d), KEYS, 64)


@query("freq_rle", FREQ + """, h as (select *, coalesce((freq <> lag(freq) over (partition by conv_id, turn order by pos))::int, 1) h from f),
  r as (select *, (sum(h) over (partition by conv_id, turn order by pos))::bigint run from h)
  select conv_id, turn, run, min(pos)::bigint as start, count(*) n, min(freq) as value from r group by conv_id, turn, run""")
def freq_rle(spark: SparkSession, d: str) -> DataFrame:
    return codecs.value_runs(_freq(spark, d), KEYS, "freq")


def _comma(x: str) -> str:
    return f"(2 * (2 + floor(ln({x}) / ln(3) + 1e-9)))::bigint"


_FIB = [1, 2]
while _FIB[-1] < 10**12:
    _FIB.append(_FIB[-1] + _FIB[-2])


@query("coder_lengths", f"""with x as (select distinct o_orderkey + 1 x from orders)
  select x, {_delta('x')}::bigint delta, (2 * {_bl('x')} - 1)::bigint gamma, {_nibble('x')} nibble,
         (len(list_filter({_FIB}, lambda f: f <= x)) + 1)::bigint fibonacci, {_comma('x')} comma,
         repeat('0', {_bl('x')}::int - 1) || bin(x) gamma_code from x""")
def coder_lengths(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    rows = read(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("x")).distinct()
    long = lambda c, n: c.cast("long").alias(n)
    return rows.select("x", long(codes.delta_length(x), "delta"), long(codes.gamma_length(x), "gamma"), long(codes.nibble_length(x), "nibble"), long(codes.fibonacci_length(x), "fibonacci"), long(codes.comma_length(x), "comma"), codes.gamma_code(x).alias("gamma_code"))


@query("delta_len", f"with x as (select distinct o_orderkey + 1 x from orders) select x, {_delta('x')}::bigint n_bits from x")
def delta_len(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("x")).distinct()
    return rows.select("x", codes.delta_length(F.col("x")).cast("long").alias("n_bits"))
