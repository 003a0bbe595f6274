r"""Repeated line runs, by a suffix array over line ids.

Lines that occur once end a sequence; the others get ids in the order of their digests.
Prefix doubling ranks every position's suffix by its first 1, 2, 4, ... lines, as far as
the deletion rule looks. The suffixes that share their first L lines are the
longest-common-prefix interval of depth L. For each position, L goes over the runs of
`min_words` words or more that fall below it without their last line or without their
first one; if the interval holds an earlier position the run is a later copy. Every
repeated run of `min_words` words is a union of such runs: those that start at its lines,
and the one that ends with it. Overlapping runs join to maximal ones, whose lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.llm.common import BROADCAST_ROWS, SPACE, broadcast_if_small, cut, fresh, row_key, table

MIN_WORDS = 50
#: Ranks in one group of a cumulative sum; a group with more is summed in two levels.
_SPAN = 1 << 16

#: A line feed before a line with a word. Lines without one belong to the line before them.
_BREAK = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def _running(keys: list[str], order: str, value: str) -> Column:
    """The sum of value over the rows before this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def line_positions(keyed: DataFrame) -> DataFrame:
    """(k1, k2, at, line, w): every line with a word, its digest and its words."""
    # the outer form, since for the inner one the optimizer repeats the split in a filter on the array's size
    blocks = keyed.select("k1", "k2", F.posexplode_outer(F.split("text", _BREAK, -1)).alias("at", "block"))
    line = F.substring_index("block", "\n", 1)
    words = F.size(F.split(F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")), " +"))
    return blocks.filter(F.col("block").rlike(rf"[^{SPACE}]")).select("k1", "k2", "at", F.unhex(F.md5(line)).alias("line"), words.alias("w"))


def repeated_positions(positions: DataFrame) -> DataFrame:
    """(k1, k2, at, seg, w, r0) for the lines that occur more than once; r0 ranks the line.

    The rank counts the positions with a smaller line, in two levels: over 4096 ranges of
    digests, and within each.
    """
    counts = positions.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = cut(counts.withColumn("range", F.conv(F.substring(F.hex("line"), 1, 3), 16, 10).cast("int")))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("range", _running([], "range", "n").alias("before"))
    ranked = counts.withColumn("within", _running(["range"], "line", "n")).join(F.broadcast(ranges), "range").select("line", (F.col("before") + F.col("within")).alias("r0"))
    if counts.count() <= BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    rows = positions.join(ranked, "line").select("k1", "k2", "at", "w", "r0").repartition("k1", "k2").dropDuplicates(["k1", "k2", "at"])
    return rows.withColumn("seg", F.col("at") - F.row_number().over(Window.partitionBy("k1", "k2").orderBy("at")))


def _double(tokens: DataFrame, k: int) -> DataFrame:
    """tokens with the rank of their first 2^(k+1) lines, from the ranks of 2^k lines.

    A rank counts the suffixes before its own. Suffixes that share a rank are told apart
    by the rank 2^k lines on: distinct pairs are counted first, then counted up within
    each first rank, in two levels of the second.
    """
    seg = Window.partitionBy("k1", "k2", "seg").orderBy("at")
    now = tokens.withColumn("next", F.lead(f"r{k}", 1 << k, -1).over(seg))
    pairs = now.groupBy(F.col(f"r{k}").alias("p"), F.col("next").alias("q")).agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("q") / _SPAN))
    spans = pairs.groupBy("p", "span").agg(F.sum("n").alias("n"))
    spans = spans.select("p", "span", _running(["p"], "span", "n").alias("before"))
    ranks = pairs.withColumn("within", _running(["p", "span"], "q", "n")).join(spans, ["p", "span"]).select("p", "q", (F.col("p") + F.col("before") + F.col("within")).alias(f"r{k + 1}"))
    return cut(now.join(ranks, (F.col(f"r{k}") == F.col("p")) & (F.col("next") == F.col("q"))).drop("next", "p", "q"))


def suffix_ranks(positions: DataFrame, depth: int) -> DataFrame:
    """Repeated positions with r0 .. rK, where 2^K >= depth: the suffix array by depth lines."""
    tokens = cut(repeated_positions(positions))
    for k in range(max(0, (depth - 1).bit_length())):
        tokens = _double(tokens, k)
    return tokens


def _depths(tokens: DataFrame, min_words: int) -> DataFrame:
    """tokens with depth and longest, both null if the sequence ends before min_words words.

    depth is the least number of lines from here that have min_words words, and longest the
    greatest with fewer than that after the first line, or depth if that is more.
    """
    ahead = Window.partitionBy("k1", "k2", "seg").orderBy("at").rowsBetween(0, min_words - 1)
    some = tokens.withColumn("ahead", F.when(F.col("w") < min_words, F.collect_list(F.least("w", F.lit(min_words))).over(ahead)))
    total = F.aggregate("ahead", F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))))
    least = some.withColumn("total", total).withColumn("depth", F.when(F.col("w") >= min_words, 1).when(F.col("total.s") >= min_words, F.col("total.n"))).drop("ahead", "total")
    seg = Window.partitionBy("k1", "k2", "seg")
    rest = F.max("at").over(seg) - F.col("at") + 1
    following = F.coalesce(F.lead("depth").over(seg.orderBy("at")), rest)  # as many lines from the next one on have min_words words, one fewer do not
    return least.withColumn("longest", F.when(F.col("depth").isNotNull(), F.greatest("depth", following)))


def later_copies(positions: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, first, last): maximal runs of lines that copy earlier ones, a run having min_words words or more.

    Ranks go as deep as the shortest runs of min_words words; the intervals of these depths
    decide every deletion, and maximal runs are the joins of runs that overlap or touch.
    """
    tokens = cut(_depths(repeated_positions(positions), min_words))
    deepest = tokens.agg(F.max("longest")).first()[0] or 0
    levels = max(0, deepest.bit_length() - 1)  # runs of depth L are named by two of 2^k <= L lines
    for k in range(levels):
        tokens = _double(tokens, k)
    k = F.floor(F.log2("depth") + 1e-9).cast("int")
    rank_at = lambda k: F.coalesce(*(F.when(k == i, F.col(f"r{i}")) for i in range(levels + 1)))
    starts = tokens.filter("depth is not null").withColumn("depth", F.explode(F.sequence("depth", "longest")))
    runs = starts.select("k1", "k2", "at", "depth", k.alias("k"), rank_at(k).alias("head"))
    tails = tokens.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("at").alias("t"), *(F.col(f"r{i}").alias(f"t{i}_") for i in range(levels + 1)))
    tail_rank = F.coalesce(*(F.when(F.col("k") == i, F.col(f"t{i}_")) for i in range(levels + 1)))
    whole = runs.filter(F.expr("depth = shiftleft(1, k)")).select("k1", "k2", "at", "depth", "head", F.col("head").alias("tail"))
    split = runs.filter(F.expr("depth <> shiftleft(1, k)"))
    split = split.join(tails, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")) & (F.expr("at + depth - shiftleft(1, k)") == F.col("t"))).select("k1", "k2", "at", "depth", "head", tail_rank.alias("tail"))
    named = cut(whole.unionAll(split))
    intervals = cut(named.groupBy("depth", "head", "tail").agg(F.min(F.struct("k1", "k2", "at")).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = named.join(broadcast_if_small(intervals), ["depth", "head", "tail"]).filter(F.struct("k1", "k2", "at") != F.col("original"))
    doc = Window.partitionBy("k1", "k2").orderBy("at")
    end = F.col("at") + F.col("depth") - 1
    seen = copies.groupBy("k1", "k2", "at").agg(F.max(end).alias("end")).withColumn("until", F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    runs = seen.withColumn("run", F.sum(F.when(F.col("at") <= F.col("until") + 1, 0).otherwise(1)).over(doc))
    return cut(runs.groupBy("k1", "k2", "run").agg(F.min("at").alias("first"), F.max("end").alias("last")).drop("run"))


def _deletions(copies: DataFrame) -> DataFrame:
    """A row for each document with deletions: its runs, and for every line up to the last deleted one whether it stays."""
    before = F.lag("last", 1, -1).over(Window.partitionBy("k1", "k2").orderBy("first"))
    gaps = copies.withColumn("gap", F.col("first") - before - 1)
    runs = gaps.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("first", "last", "gap"))).alias("runs"))
    stay = F.flatten(F.transform("runs", lambda x: F.concat(F.array_repeat(F.lit(True), x["gap"]), F.array_repeat(F.lit(False), x["last"] - x["first"] + 1))))
    return cut(runs.select("k1", "k2", "runs", stay.alias("stay")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    r"""docs with the later copies of repeated line runs taken out of the text.

    Lines are split at \n. A run is deleted where an earlier document (by id), or an
    earlier place of the same one, has the same lines, and it lies in a repeated run of
    min_words words or more. Adds deleted_lines (long) and deleted_runs (array of first
    and last line, counted over lines with a word, each with the wordless lines after it).

    Defined cases: a null text stays null and an empty one empty, with nothing deleted;
    lines without words are never repeated lines, and go with the line before them; equal
    rows (same id and text) count as one document and get the same result; equal texts
    under different ids are copies; null ids come first; an empty table stays empty; other
    columns pass through, and those named deleted_* are replaced. A text that is deleted
    whole becomes empty.
    """
    rest = docs.drop("deleted_lines", "deleted_runs")
    keyed = rest.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).filter("text is not null")
    deletions = _deletions(later_copies(cut(line_positions(keyed)), min_words))
    size = deletions.agg(F.sum(F.size("stay"))).first()[0] or 0
    n1, n2, n_runs, n_stay = fresh(docs, "k1", "k2", "runs", "stay")
    found = deletions.withColumnsRenamed({"k1": n1, "k2": n2, "runs": n_runs, "stay": n_stay})
    if size <= 8 * BROADCAST_ROWS:  # a byte a line
        found = F.broadcast(found)
    k1, k2 = row_key(id_col, text_col)
    joined = rest.join(found, (k1 == F.col(n1)) & (k2 == F.col(n2)), "left")
    text = F.array_join(F.filter(F.split(text_col, _BREAK, -1), lambda x, i: F.coalesce(F.get(n_stay, i), F.lit(True))), "\n")
    n = F.coalesce(F.aggregate(n_runs, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1), F.lit(0).cast("long"))
    runs = F.coalesce(F.transform(n_runs, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))), F.array().cast("array<struct<first:int,last:int>>"))
    new = F.when(F.col(n_stay).isNull(), F.col(text_col)).otherwise(text)
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in rest.columns), n.alias("deleted_lines"), runs.alias("deleted_runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    spans = F.array_join(F.transform("deleted_runs", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"))), ",")
    return out.select("doc_id", "deleted_lines", spans.alias("deleted_runs"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no
  from documents where text is not null),
b as (
  select *, regexp_matches(line, '[^\x20\x09-\x0D]') has,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) w
  from l),
n as (
  select *, sum(has::int) over (partition by doc_id order by no) - 1 wl,
         not first_value(has) over (partition by doc_id order by no) padded
  from b),
t as (
  select doc_id, (wl + padded::int) as pos, line, w,
         sum(w) over (partition by doc_id order by no) - w p
  from n where has),
long as (
  select a.doc_id, a.pos as pos, z.pos as fin
  from t a join t z on z.doc_id = a.doc_id and z.pos between a.pos and a.pos + {MIN_WORDS - 1}
                   and z.p + z.w - a.p >= {MIN_WORDS}),
run as (
  select doc_id, pos, min(fin) as fin from long group by doc_id, pos
  union select doc_id, max(pos) as pos, fin from long group by doc_id, fin),
keyed as (
  select r.doc_id, r.pos, r.fin, md5(string_agg(t.line, chr(10) order by t.pos)) k
  from run r join t on t.doc_id = r.doc_id and t.pos between r.pos and r.fin group by all),
copies as (
  select * from keyed qualify row_number() over (partition by k, fin - pos order by doc_id, pos) > 1),
gone as (select distinct t.doc_id, t.pos from copies c join t on t.doc_id = c.doc_id and t.pos between c.pos and c.fin),
isl as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) g from gone),
spans as (
  select doc_id, string_agg(a || ':' || z, ',' order by a) s, sum(z - a + 1) n
  from (select doc_id, g, min(pos)::bigint a, max(pos)::bigint z from isl group by all) group by doc_id),
kept as (
  select n.doc_id, string_agg(n.line, chr(10) order by n.no) txt
  from n left join gone g on g.doc_id = n.doc_id and g.pos = n.wl + n.padded::int and n.wl >= 0
  where g.pos is null group by n.doc_id)
select d.doc_id, coalesce(s.n, 0)::bigint deleted_lines, coalesce(s.s, '') deleted_runs,
       case when d.text is null then null else length(coalesce(k.txt, ''))::bigint end kept_chars,
       case when d.text is null then null else sha256(coalesce(k.txt, '')) end text_sha256
from documents d left join spans s using (doc_id) left join kept k using (doc_id)
"""
