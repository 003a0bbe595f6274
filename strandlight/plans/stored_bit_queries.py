"""The bit vectors of all conversation turns in coded form: written, read back and asked for ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.functions import codes
from strandlight.operators import codecs, stored_bits
from strandlight.plans.codec_queries import _PROJECT, _bl, _comma, _delta, _nibble
from strandlight.plans.ms_queries import _MAX, _SUM, CODE, FREQ, KEYS, MS, PAIRS, _bit_rows, _bits, _freq, _ranges
from strandlight.plans.registry import query, read
from strandlight.sources import stored


def _coded(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    """The vectors in each of the codecs, stored and read again."""
    bits = stored.store(_bits(spark, d), f"{stored.shared_folder(spark)}/bits-{uuid.uuid4().hex}", KEYS)
    folder = f"{stored.shared_folder(spark)}/coded-{uuid.uuid4().hex}"
    out = [stored_bits.compress(bits, KEYS, f"{folder}/ms", c) for c in names]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("compress_all", PAIRS + f""",
  gaps as (select conv_id, turn, bit_pos - lag(bit_pos, 1, -1) over (partition by conv_id, turn order by bit_pos) g from b where bit = 1),
  r63 as (select conv_id, turn, sum(bit) c from b group by conv_id, turn, bit_pos // 63),
  h256 as (select conv_id, turn, count(*) m, least(sum(bit), count(*) - sum(bit)) c from b group by conv_id, turn, bit_pos // 256),
  sizes as (
    select conv_id, turn, 'none' codec, length(bits) n_bits from bits
    union all select conv_id, turn, 'succinct', length(bits) + 32 * ceil(length(bits) / 512.0) from bits
    union all select conv_id, turn, 'rle', sum({_delta('zeros + 1')} + {_delta('ones')}) from pairs where ones > 0 group by all
    union all select conv_id, turn, 'nibble', sum({_nibble('zeros + 1')} + {_nibble('ones')}) from pairs where ones > 0 group by all
    union all select conv_id, turn, 'corr', sum({_delta('zeros + 1')} + {_delta(_PROJECT)}) from pairs where ones > 0 group by all
    union all select conv_id, turn, 'delta', sum({_delta('g')}) from gaps group by all
    union all select conv_id, turn, 'rrr', sum(6 + ({stored_bits.OFFSET_BITS})[(c + 1)::bigint]) from r63 group by all
    union all select conv_id, turn, 'hybrid', sum(case when c < 256 and 10 + 8 * c < m + 1 then 10 + 8 * c else m + 1 end) from h256 group by all)
  select s.conv_id, s.turn, codec, length(bits)::bigint n, n_bits::bigint n_bits, ceil(n_bits / 8.0)::bigint n_bytes from sizes s join bits using (conv_id, turn)""")
def compress_all(spark: SparkSession, d: str) -> DataFrame:
    """Every codec's files: bits of each vector, of its coded form, and its bytes."""
    return _coded(spark, d, stored_bits.CODECS).select(*KEYS, "codec", "n", "n_bits", F.length("payload").cast("long").alias("n_bytes"))


@query("decompress_all", CODE + f" select conv_id, turn, codec, bits from bits, (select unnest([{', '.join(repr(c) for c in stored_bits.CODECS)}]) codec)")
def decompress_all(spark: SparkSession, d: str) -> DataFrame:
    return stored_bits.read(_coded(spark, d, stored_bits.CODECS), KEYS)


def _coded_range(codec: str, op: str, algorithm: str, block: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = stored_bits.answer(_coded(spark, d, (codec,)), _ranges(spark, d), KEYS, codec, op, algorithm, block)
        return out.withColumn("max_value", F.col("max_value").cast("long")) if op == "max" else out.withColumn("sum", F.col("sum").cast("long"))

    return run


for _c, _op, _how, _block in [("rrr", "sum", "scan", 0), ("rrr", "sum", "runs", 0), ("rrr", "max", "scan", 0), ("rrr", "sum", "scan", 4), ("rrr", "max", "scan", 4), ("rle", "sum", "runs", 0), ("rle", "max", "runs", 0), ("delta", "sum", "runs", 0), ("nibble", "max", "runs", 0), ("succinct", "sum", "scan", 4)]:
    query(f"range_{_op}_{_c}_{'indexed' if _block else _how}", MS + (_SUM if _op == "sum" else _MAX))(_coded_range(_c, _op, _how, _block))


@query("coder_round_trip", f"""with x as (select distinct o_orderkey + 1 x from orders)
  select x::bigint x, x::bigint gamma, x::bigint delta, x::bigint nibble, x::bigint fibonacci, x::bigint comma,
         repeat('0', {_bl('x')}::int - 1) || bin(x) gamma_code,
         repeat('0', {_bl(_bl('x'))}::int - 1) || bin({_bl('x')}) || substr(bin(x), 2) delta_code,
         {_nibble('x')}::bigint nibble_bits, {_comma('x')} comma_bits from x""")
def coder_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every coder's codes of the order keys, and the values that are read back from them."""
    rows = read(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("x")).distinct()
    out = stored_bits.coder_round_trip(rows)
    size = lambda c: F.length(f"{c}_code").cast("long").alias(f"{c}_bits")
    return out.select("x", "gamma", "delta", "nibble", "fibonacci", "comma", "gamma_code", "delta_code", size("nibble"), size("comma"))


@query("freq_delta", FREQ + f" select conv_id, turn, sum({_delta('freq')})::bigint n_bits from f group by all")
def freq_delta(spark: SparkSession, d: str) -> DataFrame:
    """The bits of each turn's frequencies in delta code; freq_rle has the runs."""
    return _freq(spark, d).groupBy(*KEYS).agg(F.sum(codes.delta_length(F.col("freq"))).cast("long").alias("n_bits"))


@query("block_footprint_coded", CODE + f""", h as (
  select *, bit_pos // 64 block, coalesce((bit <> lag(bit) over (partition by conv_id, turn, bit_pos // 64 order by bit_pos))::int, 1) h from b),
  r as (select *, sum(h) over (partition by conv_id, turn, block order by bit_pos) r from h),
  n as (select conv_id, turn, block, r, count(*) n from r group by all),
  l as (select conv_id, turn, block, sum(n)::bigint no_compr, sum({_delta('n')})::bigint rle from n group by all),
  q as (select conv_id, turn, block, sum(6 + ({stored_bits.OFFSET_BITS})[(c + 1)::bigint])::bigint rrr from (
    select conv_id, turn, bit_pos // 64 block, (bit_pos % 64) // 63 part, sum(bit) c from b group by all) group by all)
  select *, least(no_compr, rle, rrr) best from l join q using (conv_id, turn, block)""")
def block_footprint_coded(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each block of 64 as it is, as runs and as rrr, and the least of them."""
    bits = _bit_rows(spark, d)
    plain = codecs.block_bits(bits, KEYS, 64).withColumnRenamed("plain", "no_compr")
    parts = bits.groupBy(*KEYS, F.floor(F.col("bit_pos") / 64).alias("block"), F.floor(F.col("bit_pos") % 64 / 63).alias("part")).agg(F.sum("bit").alias("c"))
    width = F.get(F.array(*map(F.lit, stored_bits.OFFSET_BITS)), F.col("c").cast("int"))
    rrr = parts.groupBy(*KEYS, "block").agg(F.sum(6 + width).cast("long").alias("rrr"))
    return plain.join(rrr, [*KEYS, "block"]).withColumn("best", F.least("no_compr", "rle", "rrr"))


@query("split_check", CODE + """ select conv_id, turn, 0::bigint fixed_bad, 0::bigint ones_bad, 0::bigint patterns_bad from bits""")
def split_check(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each splitting that are not what they should be: none."""
    from strandlight.operators import blocks

    bits = _bits(spark, d)
    rows = _bit_rows(spark, d)
    bad = [blocks.bad_fixed(blocks.split_fixed(rows, KEYS, 64), bits, KEYS, 64), blocks.bad_ones(blocks.split_ones(rows, KEYS, 5), bits, KEYS, 5), blocks.bad_patterns(blocks.split_patterns(rows, KEYS, 8), bits, KEYS, 8)]
    out = bits.select(*KEYS)
    for name, found in zip(("fixed_bad", "ones_bad", "patterns_bad"), bad, strict=True):
        n = found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, KEYS, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


@query("ms_print_freq_slice", FREQ + " select conv_id, turn, coalesce(string_agg(case when pos >= 3 and pos < 3 + 20 then freq::varchar end, ' ' order by pos), '') line from f group by all")
def ms_print_freq_slice(spark: SparkSession, d: str) -> DataFrame:
    from strandlight.operators import vectors

    return vectors.printed(_freq(spark, d), KEYS, "freq", 3, 20)


@query("runs_print", MS + ", r as (select conv_id, turn, pos, coalesce((ms = lag(ms) over (partition by conv_id, turn order by pos) - 1)::int, 0) runs from ms) select conv_id, turn, string_agg(runs::varchar, ' ' order by pos) line, count(*) n_bits, sum(1 - runs)::bigint n_zeros, sum(runs)::bigint n_ones from r group by all")
def runs_print(spark: SparkSession, d: str) -> DataFrame:
    """The runs vector of each turn, and how many zeros and ones it has."""
    from strandlight.operators import vectors
    from strandlight.plans.ms_queries import _ms

    runs = vectors.runs(_ms(spark, d), KEYS)
    n = runs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_bits"), F.sum(1 - F.col("runs")).cast("long").alias("n_zeros"), F.sum("runs").cast("long").alias("n_ones"))
    return vectors.printed(runs, KEYS, "runs").join(n, KEYS)
