"""Matching statistics and the vector operators against direct definitions."""

from __future__ import annotations

import random

import pytest

from strandlight.operators import blocks, lossy, matching, ranges, vectors

K = ["qid"]


def occurrences(texts, m):
    if not m:
        return sum(len(t) + 1 for t in texts)
    return sum(t.startswith(m, i) for t in texts for i in range(len(t)))


def brute(texts, t):
    out = []
    for i in range(len(t)):
        n = 0
        while i + n < len(t) and any(t[i : i + n + 1] in s for s in texts):
            n += 1
        out.append(n)
    return out


def pairs():
    r = random.Random(1432)
    word = lambda n, a="abcde": "".join(r.choice(a) for _ in range(n))
    base = word(60)
    repeated = "".join("".join(c if r.random() > 0.1 else r.choice("abcde") for c in base) for _ in range(5))
    yield "random", [word(300)], [word(50), word(150)]
    yield "repetitive", [repeated], [repeated[:150], word(50)]
    yield "collection", ["ab", "ba", "abba"], ["abab", "bbaab", ""]
    yield "absent", ["abcab"], ["zab", "abz", "z", "azb"]
    yield "same", ["mississippi"], ["mississippi", "mississippimiss", "s"]
    yield "one symbol", ["aaaa"], ["aaaaaaaa", "b"]
    yield "wide", ["übergrößé日本語"], ["größe日本", "é"]
    yield "long match", ["x" + "abcdefghij" * 9 + "y"], ["abcdefghij" * 10]


@pytest.mark.parametrize("strategy", ["automaton", "seed", "prefix"])
def test_strategies_agree_with_brute_force(spark, strategy):
    for name, texts, queries in pairs():
        if strategy != "automaton" and name not in ("collection", "absent", "long match"):
            continue
        t = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
        q = spark.createDataFrame(list(enumerate(queries)), "qid long, text string").coalesce(1)
        got: dict[int, list] = {}
        for r in matching.ms_build(t, q, K, strategy=strategy).collect():
            got.setdefault(r.qid, []).append((r.pos, r.ms))
        for i, x in enumerate(queries):
            assert sorted(got.get(i, [])) == list(enumerate(brute(texts, x))), (name, strategy, x)


def test_frequencies_bits_and_checks(spark):
    for name, texts, queries in pairs():
        if name not in ("collection", "absent", "wide"):
            continue
        t = spark.createDataFrame([(x,) for x in texts], "text string")
        q = spark.createDataFrame(list(enumerate(queries)), "qid long, text string")
        rows = matching.ms_frequency(t, q, K)
        for r in rows.collect():
            assert r.freq == occurrences(texts, queries[r.qid][r.pos : r.pos + r.ms]), name
        ms = matching.ms_build(t, q, K)
        bits = vectors.encode(ms, K)
        for r in bits.collect():
            assert len(r.bits) == 2 * len(queries[r.qid])
        assert vectors.decode(bits, K).exceptAll(ms).isEmpty() and ms.exceptAll(vectors.decode(bits, K)).isEmpty()
        assert vectors.check(ms, bits, K).filter("falls + negative + bad_length + bad_ones > 0").isEmpty()


def test_ranges_at_the_edges(spark):
    values = [3, 4, 3, 2, 3, 2, 3, 3, 4, 3, 2, 1]
    ms = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "qid long, pos long, ms int")
    asks = [(a, z) for a in range(-1, 13) for z in range(a, 15)]
    rows = spark.createDataFrame([(0, i, a, z) for i, (a, z) in enumerate(asks)], "qid long, range_id long, from_idx long, to_idx long")
    for op, algorithm, block in [("sum", "scan", 0), ("sum", "runs", 0), ("sum", "scan", 4), ("max", "scan", 0), ("max", "runs", 0), ("max", "scan", 1), ("max", "scan", 4)]:
        for r in ranges.answer(ms, rows, K, op, algorithm, block).collect():
            a, z = asks[r.range_id]
            part = values[max(a, 0) : max(z, 0)]
            if op == "sum":
                assert r["sum"] == (sum(part) if part else None), (op, algorithm, block, a, z)
            else:
                want = (max(a, 0) + part.index(max(part)), max(part)) if part else (None, None)
                assert (r.max_index, r.max_value) == want, (op, algorithm, block, a, z)
    with pytest.raises(ValueError):
        ranges.answer(ms, rows, K, "median")


def decode(bits):
    ones = [i for i, b in enumerate(bits) if b == "1"]
    return [p - 2 * i for i, p in enumerate(ones)]


@pytest.mark.parametrize("scheme", lossy.SCHEMES)
def test_lossy_contract(scheme):
    r = random.Random(5)
    for _ in range(60):
        values, v = [], 1
        for _ in range(60):
            v = max(0, v - 1) if r.random() < 0.6 else v + r.randrange(0, 9)
            values.append(v)
        bits, last = "", 1
        for v in values:
            bits += "0" * (v - last + 1) + "1"
            last = v
        new = lossy.permute(bits, 6, scheme)
        assert len(new) == len(bits) and new.count("1") == bits.count("1")
        for a, b in zip(decode(bits), decode(new), strict=True):
            assert a == b if a >= 6 else 0 <= b < 6
        cost = lossy.pair_cost(scheme, 8)
        total = lambda s: sum(cost(len(z), len(o)) for z, o in __import__("re").findall("(0+)(1+)", s))
        assert total(new) <= total(bits)


def test_blocks_and_texts(spark):
    bits = spark.createDataFrame([(0, "1000111001100")], "qid long, bits string")
    rows = vectors.bit_rows(bits, K)
    assert [(r.zeros, r.ones) for r in blocks.run_pairs(rows, K).orderBy("pair").collect()] == [(0, 1), (3, 3), (2, 2), (2, 0)]
    sizes = spark.createDataFrame([(0, 10), (1, 3)], "qid long, n long")
    got = [(r.qid, r.start, r.end) for r in blocks.slices(sizes, K, 4).orderBy("qid", "slice").collect()]
    assert got[:4] == [(0, 0, 3), (0, 3, 6), (0, 6, 8), (0, 8, 10)] and got[4:] == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 3)]
    empty = spark.createDataFrame([(0, ""), (1, None)], "qid long, text string")
    assert blocks.char_frequencies(empty, K).count() == 0
    assert matching.ms_build(empty, empty, K).count() == 0


def test_flags_that_contradict_each_other():
    bad = [{"double_rank": True, "rank_fail": True, "use_maxrep": True, "use_maxrep_rc": True}, {"lazy": True, "double_rank": True, "rank_fail": True, "use_maxrep": True}, {"use_maxrep": True, "rank_fail": True}, {"use_maxrep_rc": True, "double_rank": True}, {"rank_fail": True}, {"answer": True, "avg": True}]
    for flags in bad:
        with pytest.raises(ValueError):
            matching.Flags(**flags)
    assert matching.Flags(double_rank=True, rank_fail=True, use_maxrep=True).strategy() in matching.STRATEGIES


def test_pieces_and_tables_change_nothing(monkeypatch):
    r = random.Random(5)
    for dense in (1 << 20, 0):
        monkeypatch.setattr(matching, "DENSE", dense)
        for _ in range(40):
            monkeypatch.setattr(matching, "PIECE", r.choice([4, 16, 1024]))
            texts = ["".join(r.choice("abc") for _ in range(r.randrange(0, 60))) for _ in range(r.randrange(0, 4))]
            queries = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 90))) for _ in range(5)] + [t * 3 for t in texts[:1]]
            automaton, matcher = matching.SuffixAutomaton(texts), matching.Matcher(texts)
            for q, (ms, freq) in zip(queries, matcher.match(queries), strict=True):
                assert (ms.tolist(), freq.tolist()) == automaton.match(q)


def test_beyond_the_automaton(spark, monkeypatch):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("ab") for _ in range(n))
    texts = spark.createDataFrame([(make(60),) for _ in range(5)] + [(None,)], "text string")
    queries = spark.createDataFrame([(i, make(40)) for i in range(4)] + [(9, None)], "query_id long, text string")
    want = sorted(map(tuple, matching.ms_frequency(texts, queries).collect()))
    arrays = {x.query_id: x.ms for x in matching.ms_arrays(texts, queries).collect()}
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", 10)
    assert sorted(map(tuple, matching.ms_frequency(texts, queries).collect())) == want
    assert {x.query_id: x.ms for x in matching.ms_arrays(texts, queries).collect()} == arrays
    with pytest.raises(ValueError):
        matching.ms_vectors(texts, queries, ["query_id"])
