"""Maximal repeats of any length against their definition."""

from __future__ import annotations

import random
from collections import defaultdict

from strandlight.operators import suffixes


def repeats(texts):
    """gram: places, symbols before and after; a text's start and end are ''."""
    found = defaultdict(lambda: [0, set(), set()])
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                x = found[t[i:j]]
                x[0] += 1
                x[1].add(t[i - 1 : i])
                x[2].add(t[j : j + 1])
    return found


def test_repeats_of_any_length(spark):
    r = random.Random(12)
    phrase = "a phrase of thirty symbols, say"
    texts = [(0, f"{phrase} and {phrase}!"), (1, "a" * 40), (2, "abcabcabcabcabcabcabcabc"), (3, "".join(r.choice("ab") for _ in range(60))), (4, "x"), (5, ""), (6, None), (None, "größe\U0001f600 größe\U0001f600\x00größe"), (7, "ab ab"), (7, "ab ab"), (7, "b ab c")]
    df = spark.createDataFrame(texts, "item_id long, text string")
    by_key = defaultdict(list)
    for k, t in texts:
        by_key[k] += [t] if t else []
    for name, ok in (("maximal_repeats", lambda x: len(x[1]) > 1 and len(x[2]) > 1), ("right_maximal", lambda x: len(x[2]) > 1)):
        got = sorted((tuple(x) for x in getattr(suffixes, name)(df, ["item_id"]).collect()), key=repr)
        want = sorted(((k, gram, x[0]) for k, t in by_key.items() for gram, x in repeats(t).items() if ok(x)), key=repr)
        assert got == want, name
        assert (0, phrase, 2) in got
