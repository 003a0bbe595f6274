"""Host-level quality rules.

Each document gets word and line counts in one pass. Rule failures are summed by
host, each host's failure rate is shrunk towards a beta prior fitted to all hosts by
moments, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple[str, str, str], int] = {}
        twice = set()
        for w in windows:
            if first.setdefault(w, 0):
                twice.add(w)
            first[w] = 1
        until = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [text_counts(x.as_py()) for x in b.column(2)]
        flat = pa.array(list(chain.from_iterable(counts)), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(flat.take(pa.array(range(k, len(flat), 5), pa.int64())) for k in range(5))], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def document_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, host and the five counts of each document; a null text has no words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(_batches, f"doc_id long, host string, {METRICS}")


def with_rules(counts: DataFrame) -> DataFrame:
    """base_failed (the document's own verdict) and junk (a failure of any rule, which counts against its host)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    junk = base | (10 * F.col("n_symbols") > F.col("word_chars"))
    return counts.withColumns({"base_failed": base, "junk": junk})


def host_verdicts(ruled: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_ok.

    The prior Beta(a, b) has the mean of all documents' failures and a weight a + b
    from the spread of the hosts' rates, between 2 and 10,000. With no spread or a
    single host it is 10,000 or 2. Documents without a host take no part.
    """
    hosts = ruled.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("junk").cast("long")).alias("n_failed"))
    hosts = cut(hosts)
    all_ = hosts.agg(F.count(F.lit(1)).alias("n_hosts"), (F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.sum("n_docs").alias("total"), F.sum(F.pow(F.col("n_failed"), 2) / F.col("n_docs")).alias("sq"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n_sq"))
    # weighted between-host variance, less the binomial part: sum n (r - mean)^2 = sq - total * mean^2
    bin_var = F.col("mean") * (1 - F.col("mean"))
    spread = ((F.col("sq") - F.col("total") * F.col("mean") * F.col("mean")) - (F.col("n_hosts") - 1) * bin_var) / F.nullif(F.col("total") - F.col("n_sq") / F.col("total"), F.lit(0.0))
    weight = F.when(F.col("n_hosts") < 2, F.lit(2.0)).when(spread.isNull() | (spread <= 0), F.lit(10000.0)).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(10000.0), bin_var / spread - 1)))
    prior = all_.select("mean", weight.alias("weight"))  # one row
    rate = (F.col("mean") * F.col("weight") + F.col("n_failed")) / (F.col("weight") + F.col("n_docs"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("shrunk_rate"), (rate <= max_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each row of docs: doc_id, host, counts, base_failed, host_ok, kept.

    Defined cases: a null or empty text has no words and fails; a document without a
    host is judged by its own rules alone; repeated rows give repeated rows; an empty
    table gives an empty table; other columns of docs are not read. The verdict table
    is broadcast only up to BROADCAST_ROWS hosts; beyond that the adaptive join splits
    a hot host.
    """
    ruled = cut(with_rules(document_counts(docs, id_col, host_col, text_col)))
    verdicts = host_verdicts(ruled, max_rate).select("host", "host_ok")
    joined = ruled.join(broadcast_if_small(verdicts), "host", "left")
    ok = F.coalesce(F.col("host_ok"), F.lit(True))
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("host_ok"), (~F.col("base_failed") & ok).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host", "host_ok")


ORACLE = rf"""
with w as (
  select row_number() over () r, doc_id, source, coalesce(text, '') t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws
  from documents),
win as (
  select r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] g
  from (select r, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) > 2)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) c from win) where c > 1),
cov as (select r, count(distinct i + o) n from rep, (values (0), (1), (2)) x(o) group by r),
lin as (
  select r, count(*) - count(distinct l) n
  from (select r, unnest(string_split(t, chr(10))) l from w)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (
  select w.doc_id, w.source host, len(ws) n_words,
         length(array_to_string(ws, '')) word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
         coalesce(lin.n, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
  from w left join lin using (r) left join cov using (r)),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
         (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > word_chars)::int junk from m),
h as (select host, count(*)::double n, sum(junk)::double k from f where host is not null group by host),
a as (select count(*) nh, sum(k) / sum(n) p, sum(n) tot, sum(k * k / n) sq, sum(n * n) nsq from h),
s as (select nh, p, (sq - tot * p * p - (nh - 1) * p * (1 - p)) / nullif(tot - nsq / tot, 0) v from a),
pr as (select p, case when nh < 2 then 2.0 when v is null or v <= 0 then 10000.0
                 else greatest(2.0, least(10000.0, p * (1 - p) / v - 1)) end wt from s),
ver as (select host, (p * wt + k) / (wt + n) <= {MAX_HOST_RATE} ok from h, pr)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
       n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
       not base_failed and coalesce(ok, true) kept
from f left join ver using (host)
"""
