"""Codes and coded vectors read back what was written."""

from __future__ import annotations

import random

import pytest

from strandlight.functions import bitstrings
from strandlight.operators import stored_bits
from strandlight.sources import stored


def test_coders():
    r = random.Random(1)
    for x in [*range(1, 2000), *(r.randrange(1, 1 << 50) for _ in range(300))]:
        for write, read in bitstrings.CODERS.values():
            assert read("0" + write(x) + "101", 1) == (x, 1 + len(write(x)))
    assert bitstrings.gamma(5) == "00101" and bitstrings.delta(5) == "01101" and bitstrings.fibonacci(11) == "001011" and bitstrings.comma(7) == "100111"


def test_codecs():
    r = random.Random(2)
    for _ in range(200):
        bits = "".join(r.choice("01") * r.randrange(1, r.choice([2, 5, 80])) for _ in range(r.randrange(0, 30)))
        for codec in stored_bits.CODECS:
            coded = stored_bits.write_bits(bits, codec)
            assert stored_bits.read_bits(stored_bits._unpack(stored_bits._pack(coded), len(coded)), len(bits), codec) == bits
    assert all(stored_bits.unproject(z, stored_bits.project(z, o)) == o for z in range(40) for o in range(1, 200))


def test_what_a_codec_does_not_answer(spark):
    bits = spark.createDataFrame([(1, "0101100")], "id long, bits string")
    asked = spark.createDataFrame([(1, 0, 0, 2)], "id long, range_id int, from_idx long, to_idx long")
    for codec, op, how, block in (("rrr", "max", "runs", 0), ("rrr", "max", "runs", 4), ("rle", "max", "scan", 4), ("hybrid", "sum", "scan", 0), ("corr", "sum", "runs", 0)):
        with pytest.raises(ValueError):
            stored_bits.answer(stored_bits.write(bits, ["id"], codec), asked, ["id"], codec, op, how, block)
    with pytest.raises(ValueError):
        stored_bits.write(bits, ["id"], "zip")


def test_load_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert stored.load_or_build(spark, path, lambda: build(3)).count() == 3
    assert stored.load_or_build(spark, path, lambda: build(5)).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()  # as a write that was broken off leaves it
    assert stored.load_or_build(spark, path, lambda: build(5)).count() == 5 and built == [3, 5]
