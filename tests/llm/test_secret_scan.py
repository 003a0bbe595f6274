"""Random-looking tokens against a recomputation in plain Python, planted keys, and texts that once broke the scan."""

from __future__ import annotations

import collections
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from strandlight.llm import secret_scan as s

LETTERS = string.ascii_letters + string.digits


def upper_tail(z: float) -> float:
    x = min(abs(z), 30.0)
    t = 1 / (1 + 0.2316419 * x)
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) * math.exp(-x * x / 2) / 2.5066282746310002
    return tail if z >= 0 else 1 - tail


def measures(token: str) -> tuple[int, float, float]:
    """(length, p against a random draw, -log10 of p against text)."""
    body = token.rstrip("=")
    name, alphabet = next((n, a) for n, a in s.ENCODINGS if set(body) <= set(a))
    n, k, at = len(body), len(alphabet), [alphabet.index(c) + 1 for c in body]
    squares = sum(body.count(c) ** 2 for c in alphabet)
    half = k // 2
    high = [i > half for i in at]
    h, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * h * (n - h) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_uniform = (k * squares / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    z_runs = (runs - mean) / math.sqrt(var) if var else -1e3
    m = sum(at) / n
    spread = sum((x - m) ** 2 for x in at)
    r = sum((x - m) * (y - m) for x, y in zip(at, at[1:] + at[:1])) / spread if spread > 1e-9 else None
    z_serial = 1e3 if r is None else (r + 1 / (n - 1)) * math.sqrt(n)
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in body]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    text_pairs = n * (n - 1) / 2 * s.TEXT_SQUARES
    t_uniform = (text_pairs - (squares - n) / 2) / math.sqrt(text_pairs * (1 - s.TEXT_SQUARES) + n * (n - 1) * (n - 2) * (s.TEXT_CUBES - s.TEXT_SQUARES**2))
    t_runs = (changes - s.TEXT_CHANGES * (n - 1)) / math.sqrt(s.TEXT_CHANGES * (1 - s.TEXT_CHANGES) * (n - 1))
    share = collections.Counter("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in alphabet)
    mixed = 1 - sum((x / k) ** 2 for x in share.values())
    w_uniform = max(0.0, (text_pairs - n * (n - 1) / 2 / k) / math.sqrt(text_pairs * (1 - s.TEXT_SQUARES) + n * (n - 1) * (n - 2) * (s.TEXT_CUBES - s.TEXT_SQUARES**2)))
    w_runs = max(0.01, (mixed - s.TEXT_CHANGES) * (n - 1) / math.sqrt(s.TEXT_CHANGES * (1 - s.TEXT_CHANGES) * (n - 1)))
    p_random = min(1.0, 6 * upper_tail(max(abs(z_uniform), abs(z_runs), abs(z_serial))))
    p_text = upper_tail((w_uniform * t_uniform + w_runs * t_runs) / math.hypot(w_uniform, w_runs))
    if name in ("hex", "HEX"):
        p_text *= s.TEXT_HEX ** sum(c.isalpha() for c in body)
    return n, p_random, -math.log10(p_text)


def expected(texts: list[str]) -> set[tuple[int, int, int]]:
    """Random spans, by single p-values in bins, sorted, and a step-up by length."""
    kinds = [(re.compile(p), g, least) for _, p, g, least in s.KINDS]
    found = collections.defaultdict(list)
    for i, text in enumerate(texts):
        base = [m.span() for p, g, least in kinds for m in p.finditer(text) if len(m[g]) >= least]
        for m in re.finditer(s.TOKEN, text):
            if re.search("[A-Za-z]", m[0]) and re.search(s.NO_WORDS, m[0]) and len(m[0].rstrip("=")) >= s.LEAST:
                n, p_random, evidence = measures(m[0])
                clear = all(z <= m.start() or a >= m.end() for a, z in base)
                found[int(math.log2(n + 0.5))].append((math.floor(max(evidence, 0.0) * 20), p_random, clear, (i, m.start(), m.end())))
    out = set()
    for rows in found.values():
        rows.sort(reverse=True, key=lambda x: x[0])
        least = None
        for j, (b, *_) in enumerate(rows):
            rank = max(k for k in range(j, len(rows)) if rows[k][0] == b) + 1
            if 10.0 ** (-b / 20) <= s.FALSE_DISCOVERY_RATE * rank / len(rows):
                least = b
        out |= {where for b, p, clear, where in rows if least is not None and b >= least and p >= s.RANDOM_LEVEL and clear}
    return out


NAMES = ["subModule", "Section", "_version", "internationalTrade", "PartName", "_of_things", "assembler"]


def word(r: random.Random) -> str:
    return r.choice(["sub_module", "camelCaseName", "Section12Part4", "v2beta", "fooBar2024", "assembler86", "internationalTrade", "aaaaaaa1", "path/to/File7", "QQQQ1111", "HTTPServer2Main"]) + r.choice(["", "OfThings", "_and_2More", "Name", "=="])


def key(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def test_discoveries_are_those_of_a_recomputation(spark):
    r = random.Random(8)
    texts = []
    for _ in range(300):
        words = [word(r) + word(r) for _ in range(r.randrange(0, 12))]
        if r.random() < 0.3:
            words.append(key(r, r.choice([LETTERS, LETTERS + "+/", "0123456789abcdef", "0123456789ABCDEF", string.digits]), r.choice([16, 20, 31, 40, 70])))
        if r.random() < 0.2:
            words += ["token=" + key(r, LETTERS, 30), "my_secret_" + key(r, LETTERS, 25)]
        r.shuffle(words)
        texts.append(r.choice([" ", "\n", ", "]).join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(x.doc_id, y.start, y.end) for x in s.scan(df).collect() for y in x.spans if y.kind == "random"}
    want = expected(texts)
    assert got == want and len(want) > 30


@pytest.mark.parametrize("alphabet", [LETTERS + "+/", "0123456789ABCDEF"])
def test_nine_of_ten_planted_keys_are_found(spark, alphabet):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n))
    planted = [(n, f"{words(40)} {(k := key(r, alphabet, n))} {words(40)} {r.choice(NAMES)}{r.choice(NAMES)}{r.randrange(3000)}", k) for n in (20, 24, 32, 48, 64) for _ in range(40)]
    df = spark.createDataFrame([(i, x[1]) for i, x in enumerate(planted)], "doc_id long, text string")
    hits, others = collections.Counter(), 0
    for row in s.scan(df).filter(F.exists("spans", lambda x: x["kind"] == "random")).collect():
        n, text, k = planted[row.doc_id]
        for x in row.spans:
            hit = text[x.start : x.end] == k
            hits[n] += hit
            others += not hit
    assert min(hits[n] for n in (20, 24, 32, 48, 64)) >= 36 and others <= 20


def test_long_and_odd_texts(spark):
    texts = ["x " + "a/" * 200_000, "x " + "Ab1/" * 100_000, "9" + "=" * 20, "=" * 40, "-" * 100_000, " ".join(f"token=abcdef{i}" for i in range(10_000)), "AKIA" * 30_000, "secret" + " " * 100_000 + "= abcdefg", ""]
    out = {x.doc_id: x for x in s.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(out) == len(texts)
    assert [x.start for x in out[5].base] == [m.start() for m in re.finditer("token", texts[5])]
    assert [(x.start, x.end) for x in out[6].base if x.kind == "access"] == [(0, 120_000)]
    assert len(out[7].base) == 1 and not out[0].spans and not out[2].spans and not out[3].spans


def test_a_base_span_keeps_random_ones_off(spark):
    r = random.Random(2)
    k = key(r, LETTERS, 40)
    texts = [f"token={k}", f"my_token={k}", k, f"secret: {k} and {k}"] * 5
    for row in s.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        base = [(b.start, b.end) for b in row.base]
        random_ = [(b.start, b.end) for b in row.spans if b.kind == "random"]
        assert all(z <= x or a >= y for x, y in random_ for a, z in base)
        assert len(random_) == [0, 0, 1, 1][row.doc_id % 4]
