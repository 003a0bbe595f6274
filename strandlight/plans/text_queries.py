"""Symbols, patterns, documents, FASTA and generated texts, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators import blocks, documents, generate, suffixes
from strandlight.plans.registry import query, read
from strandlight.sources import fasta

PATTERNS = ("tion", "Licensed", "und ", "zzqq", "ñ", "eux,")
_Q = f"with q as (select unnest([{', '.join(repr(p) for p in PATTERNS)}]) pattern), m as (select pattern, doc_id, text from q join documents on contains(text, pattern)) "
_AT = _Q + """, pc as (select pattern, doc_id, text, string_split(text, pattern) p from m),
x as (select pattern, doc_id, text, unnest(p) part, generate_subscripts(p, 1) k, len(p) n from pc),
y as (select *, sum(length(part) + length(pattern)) over (partition by pattern, doc_id order by k) - length(pattern) pos from x),
at_ as (select pattern, doc_id, text, pos::bigint pos from y where k < n) """


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


@query("text_length", "select doc_id, length(regexp_replace(text, '\\n$', ''))::bigint n from documents")
def text_length(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(F.regexp_replace("text", r"\n\z", "")).cast("long").alias("n"))


@query("text_reverse", """select item_id, string_agg(substr(text, i, 1), '' order by i desc) reversed
  from benchmark, lateral (select unnest(range(1, length(text) + 1)) i) group by 1""")
def text_reverse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.reverse("text").alias("reversed"))


@query("text_extract", "select doc_id, substr(text, 11, 40) part from documents")
def text_extract(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.substr("text", F.lit(11), F.lit(40)).alias("part"))


@query("char_freq", "select symbol, count(*) n from (select unnest(string_split(text, '')) symbol from documents) group by 1")
def char_freq(spark: SparkSession, d: str) -> DataFrame:
    return blocks.char_frequencies(_docs(spark, d))


@query("char_table", "with c as (select lang, symbol, count(*) n from (select lang, unnest(string_split(text, '')) symbol from documents) group by all) select lang, symbol, n, n / sum(n) over (partition by lang) share from c")
def char_table(spark: SparkSession, d: str) -> DataFrame:
    return blocks.char_table(_docs(spark, d), ["lang"])


@query("alphabet", "select lang, symbol, row_number() over (partition by lang order by symbol)::int code from (select distinct lang, unnest(string_split(text, '')) symbol from documents)")
def alphabet(spark: SparkSession, d: str) -> DataFrame:
    return blocks.alphabet(_docs(spark, d), ["lang"])


@query("mutation_table", """with p as (select a.item_id, string_split(a.text, '') x, string_split(b.text, '') y from benchmark a join benchmark b on b.item_id = a.item_id + 1),
  z as (select item_id, unnest(x[1:least(len(x), len(y))]) char1, unnest(y[1:least(len(x), len(y))]) char2 from p)
  select item_id, char1, char2, (char1 <> char2)::int is_mut, count(*) n from z group by all""")
def mutation_table(spark: SparkSession, d: str) -> DataFrame:
    """Each passage against the next one."""
    items = read(spark, d, "benchmark")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return blocks.mutations(pairs, "text", "other", ["item_id"])


@query("repeat_bitmap", """with b as (select doc_id, text, unnest(range(0, (length(text) + 63) // 64)) block from documents),
  c as (select doc_id, block, string_split(substr(text, block * 64 + 1, 64), '') x, string_split(left(text, 64), '') y from b)
  select doc_id, block, len(list_filter(range(1, len(x) + 1), lambda i: x[i] = y[i]))::bigint n_same from c""")
def repeat_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return blocks.repeat_bitmap(_docs(spark, d), ["doc_id"], 64)


@query("block_sample", """select doc_id, sample::int sample, start, substr(text, start::int + 1, 32) as block from (
  select doc_id, text, sample, ('0x' || substr(md5('7:' || sample || ':' || doc_id), 1, 8))::bigint % (length(text) - 32 + 1) as start
  from documents, range(4) q(sample) where length(text) >= 32)""")
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_sample(_docs(spark, d), ["doc_id"], 32, 4, seed=7)


@query("slices", """with n as (select doc_id, length(text) n from documents), k as (select *, unnest(range(0, 7)) slice from n)
  select doc_id, slice::int slice, (slice * (n // 7) + least(slice, n % 7))::bigint as start, (slice * (n // 7) + least(slice, n % 7) + n // 7 + (slice < n % 7)::int)::bigint as "end" from k""")
def slices(spark: SparkSession, d: str) -> DataFrame:
    return blocks.slices(_docs(spark, d).select("doc_id", F.length("text").alias("n")), ["doc_id"], 7)


@query("block_slices", """with n as (select doc_id, length(text) n from documents), k as (select *, unnest(range(0, (n + 999) // 1000)) slice from n)
  select doc_id, slice, slice * 1000 as start, least(n, slice * 1000 + 1000) as "end" from k""")
def block_slices(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_slices(_docs(spark, d).select("doc_id", F.length("text").alias("n")), ["doc_id"], 1000)


@query("pattern_count", _Q + " select doc_id, pattern, (len(string_split(text, pattern)) - 1)::bigint n from m")
def pattern_count(spark: SparkSession, d: str) -> DataFrame:
    return documents.counts(_docs(spark, d), _patterns(spark), ["doc_id"])


@query("pattern_locate", _AT + " select doc_id, pattern, pos from at_")
def pattern_locate(spark: SparkSession, d: str) -> DataFrame:
    return documents.locate(_docs(spark, d), _patterns(spark), ["doc_id"])


@query("locate_context", _AT + " select doc_id, pattern, pos, substr(text, greatest(0, pos - 10) + 1, least(10, pos)) before, substr(text, pos + length(pattern) + 1, 10) \"after\" from at_")
def locate_context(spark: SparkSession, d: str) -> DataFrame:
    return documents.locate(_docs(spark, d), _patterns(spark), ["doc_id"], context=10)


@query("doc_rel_pos", _AT + ", s as (select doc_id, sum(length(text) + 1) over (order by doc_id) - length(text) - 1 base from documents) select doc_id, pattern, pos, (base + pos)::bigint abs_pos from at_ join s using (doc_id)")
def doc_rel_pos(spark: SparkSession, d: str) -> DataFrame:
    """Where each occurrence stands in its document, and in all of them one after the other.

    The documents' starts are summed in two levels, so that no task sees them all.
    """
    from pyspark.sql import Window

    sizes = _docs(spark, d).select("doc_id", (F.length("text") + 1).cast("long").alias("n"), F.floor(F.col("doc_id") / 4096).alias("g"))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n"))
    before = groups.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("within", within).join(before, "g").select("doc_id", (F.col("base") + F.col("within")).alias("base"))
    return pattern_locate(spark, d).join(bases, "doc_id").select("doc_id", "pattern", "pos", (F.col("base") + F.col("pos")).alias("abs_pos"))


@query("doc_list", _Q + " select distinct pattern, doc_id from m")
def doc_list(spark: SparkSession, d: str) -> DataFrame:
    return documents.listing(_docs(spark, d), _patterns(spark), "doc_id")


@query("doc_count", _Q + " select pattern, count(distinct doc_id) n_docs from q left join m using (pattern) group by 1")
def doc_count(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_counts(_docs(spark, d), _patterns(spark), "doc_id")


@query("doc_list_rle", _Q + ", g as (select pattern, doc_id, doc_id - row_number() over (partition by pattern order by doc_id) g from (select distinct pattern, doc_id from m)) select pattern, min(doc_id) as first, max(doc_id) as last from g group by pattern, g")
def doc_list_rle(spark: SparkSession, d: str) -> DataFrame:
    return documents.listing_runs(_docs(spark, d), _patterns(spark), "doc_id")


@query("doc_topk", _Q + ", c as (select pattern, doc_id, len(string_split(text, pattern)) - 1 n from m) select pattern, (row_number() over (partition by pattern order by n desc, doc_id))::int rank, doc_id, n from c qualify rank <= 10")
def doc_topk(spark: SparkSession, d: str) -> DataFrame:
    return documents.top_documents(_docs(spark, d), _patterns(spark), "doc_id", 10)


@query("grep_lines", _Q + ", l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents) select pattern, doc_id, line_no::int line_no, line from l join q on contains(line, pattern)")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.grep(_docs(spark, d), _patterns(spark), "doc_id")


@query("grep_count", _Q + ", l as (select doc_id, unnest(string_split(text, chr(10))) line from documents) select pattern, count(*) n from l join q on contains(line, pattern) group by 1")
def grep_count(spark: SparkSession, d: str) -> DataFrame:
    return documents.grep(_docs(spark, d), _patterns(spark), "doc_id").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


#: Conversations as FASTA: a header line before each turn.
_FASTA = """with l as (
  select conv_id, turn * 1000000 line_no, '>' || role || ' ' || turn line from conversations
  union all
  select conv_id, turn * 1000000 + generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) from conversations),
r as (select *, sum(starts_with(line, '>')::int) over (partition by conv_id order by line_no) record from l),
f as (
  select conv_id, record::bigint record, max(case when starts_with(line, '>') then substr(line, 2) end) header,
         coalesce(string_agg(case when not starts_with(line, '>') then line end, '' order by line_no), '') sequence
  from r where record > 0 group by conv_id, record) """


def _records(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    heads = turns.select("conv_id", (F.col("turn") * 1000000).alias("line_no"), F.concat(F.lit(">"), "role", F.lit(" "), F.col("turn").cast("string")).alias("line"))
    body = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("conv_id", (F.col("turn") * 1000000 + F.col("n") + 1).alias("line_no"), "line")
    return fasta.records(heads.unionByName(body), ["conv_id"], "line_no", "line")


@query("fasta_extract", _FASTA + " select * from f where record = 2")
def fasta_extract(spark: SparkSession, d: str) -> DataFrame:
    """The second record of each file."""
    return _records(spark, d).filter("record = 2")


@query("fasta_clean", _FASTA + " select conv_id, record, header, replace(sequence, 'N', '') sequence from f")
def fasta_clean(spark: SparkSession, d: str) -> DataFrame:
    return fasta.clean(_records(spark, d))


def _draw(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _random_sql(n: int, seed: int) -> str:
    """(pos, k): places and the numbers of their symbols."""
    return f"(select pos, ({_draw(f"'{seed}:' || pos")} % 5)::int k from range({n}) r(pos))"


def _mutate_sql(source: str, count: int, seed: int) -> str:
    at, to = _draw(f"'{seed}:at:' || pos"), _draw(f"'{seed}:to:' || pos")
    return f"(select pos, case when row_number() over (order by {at}, pos) <= {count} then (k + 1 + {to} % 4) % 5 else k end k from {source})"


def _repeat_sql(width: int, copies: int, count: int, seed: int) -> str:
    at, to = _draw(f"'{seed}:' || c || ':at:' || pos"), _draw(f"'{seed}:' || c || ':to:' || pos")
    return f"""(select c * {width} + pos as pos, case when c > 0 and row_number() over (partition by c order by {at}, pos) <= {count}
      then (k + 1 + {to} % 4) % 5 else k end k from {_random_sql(width, seed)}, range({copies}) q(c))"""


def _text_sql(source: str, name: str = "text") -> str:
    return f"(select string_agg(substr('abcde', k::int + 1, 1), '' order by pos) {name} from {source})"


@query("gen_random", f"select * from {_text_sql(_random_sql(300, 1432))}")
def gen_random(spark: SparkSession, d: str) -> DataFrame:
    return generate.joined(generate.random_text(spark, 300, seed=1432))


@query("gen_weighted", f"""select string_agg(case when u < 5 then 'a' when u < 8 then 'c' when u < 9 then 'g' else 't' end, '' order by pos) as text
  from (select pos, {_draw("'7:' || pos")} % 10 u from range(500) r(pos))""")
def gen_weighted(spark: SparkSession, d: str) -> DataFrame:
    return generate.joined(generate.random_text(spark, 500, "acgt", 7, [5, 3, 1, 1]))


@query("gen_mutate", f"select * from {_text_sql(_mutate_sql(_random_sql(300, 1432), 15, 1432))}")
def gen_mutate(spark: SparkSession, d: str) -> DataFrame:
    return generate.joined(generate.mutate(generate.random_text(spark, 300, seed=1432), 15, seed=1432))


@query("gen_repeat", f"select * from {_text_sql(_repeat_sql(60, 5, 10, 1432))}")
def gen_repeat(spark: SparkSession, d: str) -> DataFrame:
    return generate.joined(generate.repetitive(spark, 60, 5, 10, seed=1432))


_FAMILIES = [
    f"select '{kind}_300s_{way}_{m}t_abcde' pair_id, s, t from {_text_sql(s, 's')}, {_text_sql(_random_sql(m, 1432 + m) if way == 'dis' else _mutate_sql(f'(select * from {s} where pos < {m})', 15, 1432 + m), 't')}"
    for kind, s in (("rnd", _random_sql(300, 1432)), ("rep", _repeat_sql(60, 5, 10, 1432)))
    for m in (50, 150)
    for way in ("dis", "sim")
]


@query("gen_families", " union all ".join(_FAMILIES))
def gen_families(spark: SparkSession, d: str) -> DataFrame:
    return generate.families(spark, seed=1432)


@query("doc_extract", "select n, item_id, text from (select item_id, text, row_number() over (order by item_id) - 1 n from benchmark) where n in (0, 3, 7)")
def doc_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sequences 0, 3 and 7 of the collection of passages."""
    return documents.sequences(read(spark, d, "benchmark"), "item_id", [0, 3, 7]).select("n", "item_id", "text")


_COLLECTION = "select n_regionkey, row_number() over (partition by n_regionkey order by substr(n_name, pos::int + 1), n_nationkey) - 1 sa_rank, n_nationkey, pos from (select *, unnest(range(0, length(n_name))) pos from nation)"


def _collection(spark: SparkSession, d: str, part: str) -> DataFrame:
    return suffixes.collection_table(read(spark, d, "nation").filter(part), ["n_regionkey"], "n_nationkey", "n_name")


@query("collection_table", _COLLECTION)
def collection_table(spark: SparkSession, d: str) -> DataFrame:
    """The suffixes of all nations' names of a region in one order."""
    return _collection(spark, d, "true").withColumnsRenamed({"id": "n_nationkey"}).select("n_regionkey", "sa_rank", "n_nationkey", "pos")


@query("collection_merge", _COLLECTION)
def collection_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same from the tables of the nations with even and with odd keys."""
    both = suffixes.merge_collections(_collection(spark, d, "n_nationkey % 2 = 0"), _collection(spark, d, "n_nationkey % 2 = 1"), read(spark, d, "nation"), ["n_regionkey"], "n_nationkey", "n_name")
    return both.withColumnsRenamed({"id": "n_nationkey"}).select("n_regionkey", "sa_rank", "n_nationkey", "pos")
