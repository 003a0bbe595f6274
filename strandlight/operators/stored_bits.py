"""Bit vectors in coded form: written, read back, and asked for ranges.

A vector is one row, coded where it is. Codecs: `none` (the bits), `rle` (a gap and a run
length a pair of runs), `delta` (the distance of each one from the last), `nibble` (as
rle in nibbles), `corr` (run lengths by how near they are to the gap), `rrr` (blocks of
63 bits by their number of ones and their place among such blocks), `hybrid` (blocks of
256 bits, each as it is or by the places of its rarer bit) and `succinct` (the bits and a
sample of their ranks every 512).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions import bitstrings as bs
from strandlight.operators import blocks, ranges, vectors
from strandlight.sources import stored

CODECS = ("none", "rle", "delta", "nibble", "corr", "rrr", "hybrid", "succinct")
RRR, HYBRID, SAMPLE = 63, 256, 512
#: Bits of the place of a block of 63 with k ones among all such blocks.
OFFSET_BITS = [(comb(RRR, k) - 1).bit_length() for k in range(RRR + 1)]
_RUNS = re.compile("0*1+|0+")


def project(zeros: int, ones: int) -> int:
    return 2 * (zeros - ones) if ones < zeros else 2 * (ones - zeros) + 1 if ones < 2 * zeros else ones


def unproject(zeros: int, code: int) -> int:
    if code >= 2 * zeros:
        return code
    return zeros + code // 2 if code % 2 else zeros - code // 2


def _block_number(bits: str) -> int:
    """The place of a block among the blocks with as many ones, in the order of the places of their ones."""
    ones = [len(bits) - 1 - i for i, b in enumerate(bits) if b == "1"]
    return sum(comb(p, len(ones) - i) for i, p in enumerate(ones))


def _block_bits(n: int, ones: int, number: int) -> str:
    out = []
    for p in range(n - 1, -1, -1):
        here = comb(p, ones) if ones else 0
        if ones and number >= here:
            out.append("1")
            number, ones = number - here, ones - 1
        else:
            out.append("0")
    return "".join(out)


def _write_hybrid(block: str) -> str:
    rare = "1" if block.count("1") * 2 <= len(block) else "0"
    places = [i for i, b in enumerate(block) if b == rare]
    short = "1" + rare + f"{len(places):08b}" + "".join(f"{p:08b}" for p in places)
    return short if len(places) < HYBRID and len(short) < len(block) + 1 else "0" + block


def write_bits(bits: str, codec: str) -> str:
    """The coded form of a string of 0 and 1, itself such a string."""
    if codec == "none":
        return bits
    if codec == "succinct":
        return bits + "".join(f"{bits.count('1', 0, p):032b}" for p in range(0, len(bits), SAMPLE))
    if codec == "rrr":
        cut = [bits[i : i + RRR].ljust(RRR, "0") for i in range(0, len(bits), RRR)]
        return "".join(f"{(k := b.count('1')):06b}" + (f"{_block_number(b):0{OFFSET_BITS[k]}b}" if OFFSET_BITS[k] else "") for b in cut)
    if codec == "hybrid":
        return "".join(_write_hybrid(bits[i : i + HYBRID]) for i in range(0, len(bits), HYBRID))
    if codec == "delta":
        ones = [i for i, b in enumerate(bits) if b == "1"]
        return "".join(map(bs.delta, (y - x for x, y in zip([-1, *ones], ones))))
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    code = bs.nibble if codec == "nibble" else bs.delta
    pairs = [(x.count("0"), x.count("1")) for x in _RUNS.findall(bits)]
    return "".join(code(z + 1) + code(project(z, o) if codec == "corr" else o) for z, o in pairs if o)


def read_bits(coded: str, n: int, codec: str) -> str:
    """The n bits that a coded form stands for."""
    if codec in ("none", "succinct"):
        return coded[:n]
    out: list[str] = []
    at = 0
    if codec == "rrr":
        for i in range(0, n, RRR):
            k = int(coded[at : at + 6], 2)
            at += 6 + OFFSET_BITS[k]
            out.append(_block_bits(RRR, k, int(coded[at - OFFSET_BITS[k] : at] or "0", 2)))
        return "".join(out)[:n]
    if codec == "hybrid":
        for i in range(0, n, HYBRID):
            size = min(HYBRID, n - i)
            if coded[at] == "0":
                out.append(coded[at + 1 : at + 1 + size])
                at += 1 + size
                continue
            rare, places = coded[at + 1], int(coded[at + 2 : at + 10], 2)
            at += 10
            block = ["0" if rare == "1" else "1"] * size
            for _ in range(places):
                block[int(coded[at : at + 8], 2)] = rare
                at += 8
            out.append("".join(block))
        return "".join(out)
    read = bs.read_nibble if codec == "nibble" else bs.read_delta
    while at < len(coded):
        gap, at = read(coded, at)
        if codec == "delta":
            out.append("0" * (gap - 1) + "1")
            continue
        ones, at = read(coded, at)
        out.append("0" * (gap - 1) + "1" * (unproject(gap - 1, ones) if codec == "corr" else ones))
    return "".join(out).ljust(n, "0")


def _pack(bits: str) -> bytes:
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")


def _unpack(payload: bytes, n: int) -> str:
    return f"{int.from_bytes(payload, 'big'):0{8 * len(payload)}b}"[:n] if payload else ""


def _kept(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def write(bits: DataFrame, keys: Sequence[str], codec: str) -> DataFrame:
    """keys, codec, n (bits of the vector), n_bits (of its coded form), payload."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            coded = [write_bits(x, codec) for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([codec] * len(texts), pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in coded], pa.int64()), pa.array([_pack(x) for x in coded], pa.binary())], names=[*b.schema.names[:-1], "codec", "n", "n_bits", "payload"])

    return bits.filter(F.col("bits").isNotNull()).select(*keys, "bits").mapInArrow(run, _kept(bits, keys, "codec string, n bigint, n_bits bigint, payload binary"))


def read(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, codec, bits from the coded forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            found = [read_bits(_unpack(p, m), n, c) for c, n, m, p in zip(x["codec"], x["n"], x["n_bits"], x["payload"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("codec"), pa.array(found, pa.string())], names=[*keys, "codec", "bits"])

    return coded.select(*keys, "codec", "n", "n_bits", "payload").mapInArrow(run, _kept(coded, keys, "codec string, bits string"))


def compress(bits: DataFrame, keys: Sequence[str], path: str, codec: str) -> DataFrame:
    """The coded forms, stored as path.codec and read again."""
    return stored.store(write(bits, keys, codec), f"{path}.{codec}", list(keys))


def islands(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first, n, top: runs of values that fall by one, from the runs of ones; no row for a bit or a position."""
    pairs = blocks.pairs_of_bits(bits, keys).filter("ones > 0")
    before = F.coalesce(F.sum("ones").over(Window.partitionBy(*keys).orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = pairs.withColumn("first", before)
    return at.select(*keys, "first", F.col("ones").alias("n"), (F.col("start") + F.col("zeros") - 2 * F.col("first")).alias("top"))


#: (operation, algorithm) that a codec answers without an index, and with one.
SUPPORT = {
    "none": ({("sum", "scan"), ("sum", "runs"), ("max", "scan"), ("max", "runs")}, {("sum", "scan"), ("sum", "runs"), ("max", "scan")}),
    "rrr": ({("sum", "scan"), ("sum", "runs"), ("max", "scan")}, {("sum", "scan"), ("sum", "runs"), ("max", "scan")}),
    **{c: ({("sum", "scan"), ("sum", "runs"), ("max", "scan"), ("max", "runs")}, {("sum", "scan"), ("sum", "runs")}) for c in ("rle", "delta", "nibble", "succinct")},
}


def answer(coded: DataFrame, asked: DataFrame, keys: Sequence[str], codec: str, op: str = "sum", algorithm: str = "scan", block: int = 0) -> DataFrame:
    """Ranges over coded vectors (from write or compress), by codec, operation, algorithm and index.

    Combinations that the engine does not offer raise ValueError. With an index, or by a
    scan, the values are read off the bits; by runs, no value is written out.
    """
    if codec not in SUPPORT or (op, algorithm) not in SUPPORT[codec][bool(block)]:
        raise ValueError(f"{codec} does not answer {op} by {algorithm}" + " with an index" * bool(block))
    bits = read(coded.filter(F.col("codec") == codec), keys).drop("codec")
    if algorithm == "scan" or block:
        return ranges.answer(vectors.decode(bits, keys), asked, keys, op, "scan", block)
    return (ranges.sum_over_runs if op == "sum" else ranges.max_over_runs)(islands(bits, keys), asked, keys)


def coder_round_trip(numbers: DataFrame, column: str = "x") -> DataFrame:
    """x, and for each coder its code and the value that is read back from it with other codes behind."""
    names = list(bs.CODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b.column(0).to_pylist()
            codes = {c: [w(x) for x in xs] for c, (w, _) in bs.CODERS.items()}
            back = {c: [r(a + z, 0)[0] for a, z in zip(codes[c], codes[c][1:] + [""])] for c, (_, r) in bs.CODERS.items()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(codes[c], pa.string()) for c in names), *(pa.array(back[c], pa.int64()) for c in names)], names=[column, *(f"{c}_code" for c in names), *names])

    return numbers.select(F.col(column).cast("long").alias(column)).mapInArrow(run, ", ".join([f"`{column}` bigint", *(f"{c}_code string" for c in names), *(f"{c} bigint" for c in names)]))


