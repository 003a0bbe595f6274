"""Tree navigation and searches against plain string comparison, on texts of many shapes."""

from __future__ import annotations

import random

import pytest

from strandlight.operators import trees

TEXTS = ["a", "aa", "abab", "banana", "mississippi", "aaaaaaaaaa", "é日é日é\U0001f600", "abcabcabx" * 3, "ab" * 40 + "c"]


@pytest.mark.parametrize("text", TEXTS)
def test_nodes_links_and_steps(text):
    t = trees.Tree(text)
    suffixes = sorted(range(len(text)), key=lambda p: text[p:])
    assert t.sa == suffixes

    def interval(w):
        ranks = [r for r, p in enumerate(suffixes) if text.startswith(w, p)]
        return (ranks[0], ranks[-1]) if ranks else None

    for v, (lo, hi, depth) in enumerate(t.nodes):
        w = text[t.sa[hi] : t.sa[hi] + depth]
        assert interval(w) == (lo, hi) or lo == hi
        if lo < hi and depth:
            to = t.nodes[t.suffix_link(v)]
            assert (to[0], to[1]) == interval(w[1:]) or depth == 1
        for c in set(text):
            if lo < hi and depth:
                assert t.back(lo, hi, c) == interval(c + w)
                assert t.narrow(lo, hi, depth, c) == interval(w + c)
        below = t.children.get(v, [])
        assert not below or (t.nodes[below[0]][0] == lo and t.nodes[below[-1]][1] == hi)


def test_searches(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("ab") for _ in range(r.randrange(1, 40)))) for i in range(12)] + [(12, None), (13, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    patterns = ["a", "ab", "abba", "bbbbb", "c", ""]

    def want(text, w):
        ranks = [k for k, p in enumerate(sorted(range(len(text)), key=lambda p: text[p:])) if text.startswith(w, p)]
        return (ranks[0], ranks[-1]) if ranks else None

    for way in ("backward", "forward", "both"):
        got = {(x.id, x.pattern, x.step): x for x in trees.search(df, patterns, ["id"], way).collect()}
        n = 0
        for i, text in texts:
            for p in patterns:
                for k in range(1, len(p) + 1):
                    w = p[-k:] if way == "backward" else p[:k] if way == "forward" else p[len(p) // 2 : len(p) // 2 + k] if len(p) // 2 + k <= len(p) else p[-k:]
                    found = want(text or "", w)
                    if found:
                        n += 1
                        x = got[i, p, k]
                        assert (x.lo, x.hi) == found and (way != "both" or (x.r_lo, x.r_hi) == want(text[::-1], w[::-1]))
        assert n == len(got)
    with pytest.raises(ValueError):
        trees.search(df, patterns, ["id"], "sideways")
