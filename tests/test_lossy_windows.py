"""Lossy forms: large, first and last windows."""

from __future__ import annotations

import random
import re

import pytest

from strandlight.operators import lossy

TAU = 7


def vector(r, n, top=TAU + 3):
    """Values of n positions and their bits."""
    values, v = [], 1
    for _ in range(n):
        v = max(0, v - 1) if r.random() < 0.7 else min(top, v + r.randrange(0, 4))
        values.append(v)
    bits, last = "", 1
    for v in values:
        bits += "0" * (v - last + 1) + "1"
        last = v
    return values, bits


def decode(bits):
    return [p - 2 * i for i, p in enumerate(i for i, b in enumerate(bits) if b == "1")]


def total(bits, scheme):
    cost = lossy.pair_cost(scheme, 8)
    return sum(cost(len(z), len(o)) for z, o in re.findall("(0+)(1+)", bits))


def holds(values, bits, new, low=0):
    assert len(new) == len(bits) and new.count("1") == bits.count("1")
    assert all(a == b if a >= TAU else low <= b < TAU for a, b in zip(values, decode(new), strict=True))


@pytest.mark.parametrize("scheme", lossy.SCHEMES)
@pytest.mark.parametrize("negative", [False, True])
def test_large_windows_cost_less(scheme, negative):
    r = random.Random(9)
    for n in (60, 150):
        inner, _ = vector(r, n, TAU - 1)
        start = list(range(TAU, inner[0] - 1, -1)) if inner[0] < TAU else [TAU]
        values, bits, last = [*start, *inner, TAU + 2], "", 1
        for v in values:
            bits += "0" * (v - last + 1) + "1"
            last = v
        assert inner.count(0) < n and bits.count("0") * bits.count("1") > 2 * lossy.MAX_GRID
        new = lossy.permute(bits, TAU, scheme, negative)
        holds(values, bits, new, -len(bits) if negative else 0)
        assert total(new, scheme) < 0.9 * total(bits, scheme)


@pytest.mark.parametrize("scheme", lossy.SCHEMES)
def test_band_has_the_least_cost(scheme):
    cost = lossy.pair_cost(scheme, 8)
    for value in range(TAU):
        band = lossy.Band(value, TAU, cost)
        for zeros in range(1, 13):
            for ones in range(1, 16):
                if 0 <= value + zeros - ones < TAU:
                    want = lossy.best_window(zeros, ones, value, TAU, False, cost)
                    pairs = band.pairs(zeros, ones)
                    assert (sum(z for z, _ in pairs), sum(o for _, o in pairs)) == (zeros, ones)
                    assert sum(cost(*p) for p in pairs) == sum(cost(*p) for p in want)
                    assert pairs == want


@pytest.mark.parametrize("scheme", lossy.SCHEMES)
@pytest.mark.parametrize("negative", [False, True])
def test_first_and_last_windows_cost_less(scheme, negative):
    r = random.Random(10)
    for k in range(30):
        low = vector(r, 40, TAU - 1)
        values, bits = low if k % 3 == 0 else vector(r, 60)
        bits += "0" * (k % 2)
        new = lossy.permute(bits, TAU, scheme, negative)
        holds(values, bits, new, -len(bits) if negative else 0)
        assert total(new, scheme) <= total(bits, scheme)
        if k % 3 == 0:  # no value reaches tau: the whole vector is one window
            assert total(new, scheme) < total(bits, scheme)
    kept = "0" * TAU + "1"  # a value of tau
    alternate = "01" * 20
    for bits, at in ((alternate + kept, slice(0, 40)), (kept + "1" + alternate, slice(9, None))):
        new = lossy.permute(bits, TAU, scheme, negative)
        assert total(new, scheme) < total(bits, scheme) and new[at] != bits[at] and new.count("1") == bits.count("1")
    assert lossy.permute("1" + "0" * 9 + "1", TAU, scheme, negative) == "1" + "0" * 9 + "1" and lossy.permute("", TAU, scheme, negative) == ""


def test_windows_have_the_first_and_the_last(spark):
    vectors = {0: [1, 2, 7, 6, 5, 8, 7, 6, 5, 4, 3, 2, 1, 0], 1: [3, 2, 1], 2: [9, 8, 7], 3: [1, 9, 8, 7, 6]}
    ms = spark.createDataFrame([(q, i, v) for q, x in vectors.items() for i, v in enumerate(x)], "qid long, pos long, ms int")
    got = {part: sorted(tuple(x) for x in lossy.windows(ms, ["qid"], TAU, part).collect()) for part in ("all", "inner", "ends")}
    assert got["inner"] == [(0, 1, 3, 4, 4)]
    assert got["ends"] == [(0, 0, 0, 1, 9), (0, 3, 7, 13, 1), (1, 0, 0, 2, 3), (3, 0, 0, 0, 10), (3, 3, 4, 4, 0)]
    assert got["all"] == sorted(got["inner"] + got["ends"])
    with pytest.raises(ValueError):
        lossy.windows(ms, ["qid"], TAU, "middle")
