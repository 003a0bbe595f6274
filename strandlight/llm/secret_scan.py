"""Secrets in texts: fixed patterns, and tokens that look random.

Candidate tokens go through a battery per inferred encoding: chi-squared uniformity over
the encoding's alphabet, runs, and the lag-1 serial correlation. Against "drawn at random" a token must fail none of the three (Bonferroni).
Against "text" (letters repeat and character classes keep together, as in prose and
identifiers) uniformity and runs, weighted by what a random token of that encoding and
length shows, give one p-value; serial correlation has no weight there, since neighbours
in a word are no more alike than random ones. A token of hexadecimal letters alone has
that chance in text as a factor. The p-values go through Benjamini-Hochberg control among
tokens of similar length, over the whole table: short tokens, which tell less, do not
borrow the evidence of long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, table

#: Fixed patterns (kind, Java pattern, group whose length counts, its least length), in the order of the contract.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 0, 20),
    ("hex", r"([0-9a-f]{24,})", 0, 24),
)
TOKEN = r"([A-Za-z0-9+/_=-]{16,})"
#: Least length of a token without the = at its end.
LEAST = 16
#: What a token has somewhere that is not made of words and short numbers joined by - _ / = +. No repeated group:
#: Java would recurse for each repeat.
NO_WORDS = "[0-9][A-Za-z]|[A-Za-z][0-9]|[0-9]{5}|^[0-9]"
_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the least alphabet that holds a token (its = padding aside).
ENCODINGS = (
    ("decimal", _DIGIT),
    ("hex", _DIGIT + "abcdef"),
    ("HEX", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER),
    ("base62", _DIGIT + _LOWER + _UPPER),
    ("base64", _DIGIT + _LOWER + _UPPER + "+/"),
    ("base64url", _DIGIT + _LOWER + _UPPER + "-_"),
    ("mixed", _DIGIT + _LOWER + _UPPER + "+/-_="),
)
#: Text: sum of squares and of cubes of letter frequencies, how often the character class changes, and the share of
#: letters from a to f.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES, TEXT_HEX = 0.065, 0.006, 0.2, 0.317
FALSE_DISCOVERY_RATE = 0.01
#: A token passes the battery if its p-value against a random draw is not below this.
RANDOM_LEVEL = 0.001
_STEP = 20  # bins of a power of ten
_SPAN = "array<struct<start:int,no:int,end:int,kind:string>>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _parts(pattern: str, group: int, keep: str = "") -> Column:
    """For each match in `text`: code points before it since the last one (gap), in it (size) and in its group (key)."""
    p = _quoted(pattern)
    return F.expr(
        f"""case when text rlike '{p}' then transform(
          arrays_zip(split(text, '{p}', -1), regexp_extract_all(text, '{p}', 0), regexp_extract_all(text, '{p}', {group})),
          x -> named_struct('gap', length(x['0']), 'size', coalesce(length(x['1']), 0), 'key', coalesce(length(x['2']), 0){keep})) end"""
    )


def _starts(parts: str) -> Column:
    """Where each match begins. Sums run within chunks of about the square root of the number of matches, and over
    the chunks, since an array that grows by one is copied each time."""
    return F.expr(
        f"""aggregate(
          transform(sequence(0, int((size({parts}) - 1) / ceil(sqrt(size({parts}))))), i -> slice({parts}, int(i * ceil(sqrt(size({parts}))) + 1), int(ceil(sqrt(size({parts})))))),
          named_struct('at', 0, 'out', cast(array() as array<array<int>>)),
          (a, c) -> named_struct(
            'at', a.at + aggregate(c, 0, (s, x) -> s + x.gap + x.size),
            'out', concat(a.out, array(aggregate(c, named_struct('at', a.at, 'out', cast(array() as array<int>)),
              (b, x) -> named_struct('at', b.at + x.gap + x.size, 'out', concat(b.out, array(b.at + x.gap))), b -> b.out)))),
          a -> flatten(a.out))"""
    )


def _spans(no: int, kind: str, least: int) -> Column:
    """The spans of a kind from its matches and their starts."""
    return F.expr(
        f"""coalesce(transform(filter(arrays_zip({kind}_parts, {kind}_starts), x -> x.{kind}_parts.key >= {least}),
          x -> named_struct('start', x.{kind}_starts, 'no', {no}, 'end', x.{kind}_starts + x.{kind}_parts.size, 'kind', '{kind}')), cast(array() as {_SPAN}))"""
    )


def _tokens() -> Column:
    """Candidate tokens from the matches of TOKEN: start, end, tok. Digits without letters are numbers."""
    return F.expr(
        f"""coalesce(transform(filter(arrays_zip(token_parts, token_starts), x -> x.token_parts.key > 0 and x.token_parts.tok rlike '[A-Za-z]' and x.token_parts.tok rlike '{NO_WORDS}' and length(rtrim('=', x.token_parts.tok)) >= {LEAST}),
          x -> named_struct('start', x.token_starts, 'end', x.token_starts + x.token_parts.size, 'tok', x.token_parts.tok)), cast(array() as array<struct<start:int,end:int,tok:string>>))"""
    )


def _changes(marks: str, letters: str) -> str:
    """SQL for how often neighbours differ in a string of the given letters."""
    return " + ".join(f"(length({marks}) - length(replace({marks}, '{a}{b}', ''))) / 2" for a in letters for b in letters if a != b)


def _mixed(alphabet: str) -> float:
    """How often two letters drawn from an alphabet are of different character classes."""
    shares = [sum(c in part for c in alphabet) / len(alphabet) for part in (_DIGIT, _LOWER, _UPPER, "+/-_=")]
    return 1 - sum(x * x for x in shares)


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (tok, LEAST code points or more) with n, encoding, z_uniform, z_runs, z_serial and p_random (against a
    random draw), t_uniform, t_runs (against text, large: too random for it) and evidence (-log10 of p).

    Against random, means and variances are exact for the multinomial chi-squared and for
    the runs, given the counts on either side; the serial correlation has mean -1/(n-1)
    and variance 1/n. Against text, runs are those of character classes.
    """
    body = tokens.withColumn("body", F.regexp_replace("tok", "=+$", ""))
    holds = lambda alphabet: F.length(F.translate("body", alphabet, "")) == 0
    name, alphabet, mixed = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][1]), F.lit(_mixed(ENCODINGS[-1][1]))
    for n, a in reversed(ENCODINGS[:-1]):
        name, alphabet, mixed = (F.when(holds(a), x).otherwise(y) for x, y in ((n, name), (a, alphabet), (_mixed(a), mixed)))
    t = body.withColumns({"encoding": name, "alphabet": alphabet, "mixed": mixed}).withColumns({"k": F.length("alphabet").cast("double"), "n": F.length("body").cast("double")})
    t = t.withColumn("marks", F.expr("translate(body, alphabet, concat(repeat('L', int(k / 2)), repeat('H', int(k) - int(k / 2))))"))
    t = t.withColumn("kinds", F.translate("body", _LOWER + _UPPER + _DIGIT + "+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "-----"))
    squares = F.expr("aggregate(split(alphabet, ''), 0D, (s, c) -> s + power(length(body) - length(replace(body, c, '')), 2))")
    serial = F.expr(
        """aggregate(split(body, ''),
          named_struct('prev', cast(null as double), 's', 0D, 'q', 0D, 'l', 0D, 'first', cast(null as double)),
          (a, c) -> named_struct('prev', double(instr(alphabet, c)), 's', a.s + instr(alphabet, c), 'q', a.q + power(instr(alphabet, c), 2),
            'l', a.l + coalesce(a.prev * instr(alphabet, c), 0D), 'first', coalesce(a.first, double(instr(alphabet, c)))))"""
    )
    t = t.withColumns({"squares": squares, "serial": serial})
    t = t.withColumns({"chi": F.expr("k * squares / n - n"), "high": F.expr("n - length(replace(marks, 'H', ''))"), "runs": F.expr("1 + " + _changes("marks", "LH")), "changes": F.expr(_changes("kinds", "aA0-"))})
    # circular lag-1 correlation
    t = t.withColumn("r", F.expr("(serial.l + serial.prev * serial.first - serial.s * serial.s / n) / nullif(serial.q - serial.s * serial.s / n, 0)"))
    t = t.withColumns({"run_mean": F.expr("1 + 2 * high * (n - high) / n"), "pairs": F.expr("(squares - n) / 2"), "text_pairs": F.expr(f"n * (n - 1) / 2 * {TEXT_SQUARES}")})
    t = t.withColumns(
        {
            "z_uniform": F.expr("(chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)"),
            "z_runs": F.expr("coalesce((runs - run_mean) / sqrt(nullif((run_mean - 1) * (run_mean - 2) / (n - 1), 0)), -1e3)"),
            "z_serial": F.expr("coalesce((r + 1 / (n - 1)) * sqrt(n), 1e3)"),
            "t_uniform": F.expr(f"(text_pairs - pairs) / sqrt(text_pairs * {1 - TEXT_SQUARES} + n * (n - 1) * (n - 2) * {TEXT_CUBES - TEXT_SQUARES**2})"),
            "t_runs": F.expr(f"(changes - {TEXT_CHANGES} * (n - 1)) / sqrt({TEXT_CHANGES * (1 - TEXT_CHANGES)} * (n - 1))"),
            "w_uniform": F.expr(f"greatest(0D, (text_pairs - n * (n - 1) / 2 / k) / sqrt(text_pairs * {1 - TEXT_SQUARES} + n * (n - 1) * (n - 2) * {TEXT_CUBES - TEXT_SQUARES**2}))"),
            "w_runs": F.expr(f"greatest(0.01D, (mixed - {TEXT_CHANGES}) * (n - 1) / sqrt({TEXT_CHANGES * (1 - TEXT_CHANGES)} * (n - 1)))"),
        }
    )
    worst = F.greatest(*(F.abs(f"z_{x}") for x in ("uniform", "runs", "serial")))
    letters = F.length("body") - F.length(F.translate("body", _LOWER + _UPPER, ""))
    both = (F.col("w_uniform") * F.col("t_uniform") + F.col("w_runs") * F.col("t_runs")) / F.hypot("w_uniform", "w_runs")
    in_hex = F.when(F.col("encoding").isin("hex", "HEX"), letters * -math.log10(TEXT_HEX)).otherwise(0.0)
    t = t.withColumns({"p_random": F.least(F.lit(1.0), 6 * _upper_tail(worst)), "evidence": in_hex - F.log10(_upper_tail(both))})
    return t.withColumn("n", F.col("n").cast("int")).drop("body", "alphabet", "k", "marks", "kinds", "squares", "serial", "chi", "high", "runs", "changes", "r", "run_mean", "pairs", "text_pairs", "mixed", "w_uniform", "w_runs")


def _upper_tail(z: Column) -> Column:
    """P(Z > z), by the polynomial of Abramowitz and Stegun 26.2.17, as if z were 30 at most."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(z >= 0, tail).otherwise(1 - tail)


def discoveries(scored: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """(stratum, least): by length, the least bin of evidence that is significant.

    A stratum holds the lengths from one power of two to the next. Bins of 1/20 of a power
    of ten replace single p-values, each with the largest p of its bin, which keeps the
    control and makes the table as small as the number of bins.
    """
    binned = scored.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = binned.withColumn("rank", F.sum("n").over(down)).join(F.broadcast(sizes), "stratum")
    significant = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / _STEP) <= rate * F.col("rank") / F.col("m"))
    return significant.groupBy("stratum").agg(F.min("bin").alias("least"))


def _apart(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """The tokens of chosen (row, start, end) that overlap no base span of their row."""
    rows = cut(chosen.select("row").distinct())
    base = found.join(broadcast_if_small(rows), "row", "left_semi").select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", F.lit(0).alias("token"))
    both = base.unionAll(chosen.select("row", "start", "end", F.lit(1).alias("token")))
    ahead = Window.partitionBy("row").orderBy("start", "token").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("token")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("until", F.max(F.when(F.col("token") == 0, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(F.col("token") == 0, F.col("start"))).over(behind))
    return seen.filter((F.col("token") == 1) & (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))).select("row", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """One row for each row of docs: doc_id, base and spans (arrays of start, no, end, kind).

    Positions count code points, end exclusive; a span is the whole match. Random tokens
    (kind random) that overlap no fixed match are added to the base spans. Defined cases:
    a null or empty text has no spans; repeated rows each get a row, and count as many
    tokens as rows in the control; with no candidate tokens nothing is added; an empty
    table stays empty; other columns are not read. One pass over the texts leaves their
    spans and token scores in the checkpoint folder; the thresholds come from those.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = text.select("doc_id", *(_parts(p, g).alias(f"{k}_parts") for k, p, g, _ in KINDS), _parts(TOKEN, 0, ", 'tok', x['1']").alias("token_parts"))
    kinds = [*(k for k, *_ in KINDS), "token"]
    parts = parts.withColumns({f"{k}_starts": _starts(f"{k}_parts") for k in kinds})
    spans = parts.select("doc_id", F.array_sort(F.concat(*(_spans(i, k, n) for i, (k, _, _, n) in enumerate(KINDS)))).alias("base"), _tokens().alias("tokens"))
    found = cut(spans.withColumn("row", F.monotonically_increasing_id()))
    each = found.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.tok")
    scored = cut(battery(each).select("row", "start", "end", "p_random", F.floor(F.log2(F.col("n") + 0.5)).alias("stratum"), F.floor(F.greatest("evidence", F.lit(0.0)) * _STEP).alias("bin")))
    limits = discoveries(scored, rate)
    chosen = cut(scored.filter(F.col("p_random") >= RANDOM_LEVEL).join(F.broadcast(limits), "stratum").filter(F.col("bin") >= F.col("least")).select("row", "start", "end"))
    token = F.struct(F.col("start"), F.lit(len(KINDS)).alias("no"), F.col("end"), F.lit("random").alias("kind"))
    random = cut(_apart(chosen, found).groupBy("row").agg(F.collect_list(token).alias("random")))
    joined = found.drop("tokens").join(broadcast_if_small(random), "row", "left")
    added = F.coalesce("random", F.expr(f"cast(array() as {_SPAN})"))
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(n(k) for k, *_ in KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
