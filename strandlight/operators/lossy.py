"""Bit forms with fewer bits to code that keep every value from a threshold on.

Between two ones whose values reach tau, before the first such one and after the last,
zeros and ones may change places as long as their numbers stay and no value in between reaches tau or, unless allowed, falls below
0. Each such window is permuted on its own for the least code length; a window has the
zeros and ones from its first zero to its last one, so the runs around stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMES = ("diff", "diff_long", "none")
#: Where values below 0 are allowed: largest product of zeros and ones of a window that is searched whole. Larger ones are first cut down by greedy steps.
MAX_GRID = 400


def _delta(x: int) -> int:
    n = x.bit_length()
    return n + 2 * n.bit_length() - 2


def recode(zeros: int, ones: int, threshold: int) -> int:
    """As `functions.codes.project` with base 1."""
    if zeros <= threshold or ones >= 2 * zeros:
        return ones
    return 2 * (zeros - ones) if ones < zeros else 2 * (ones - zeros) + 1


def pair_cost(scheme: str, threshold: int) -> Callable[[int, int], int]:
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    if scheme == "none":
        return lambda z, o: _delta(z) + _delta(o)
    return lambda z, o: _delta(z) + _delta(recode(z, o, threshold if scheme == "diff_long" else 0))


def best_window(zeros: int, ones: int, value: int, tau: int, negative: bool, cost: Callable[[int, int], int]) -> list[tuple[int, int]] | None:
    """The cheapest run pairs with these sums. value is that of the one before; each one after k zeros and
    j ones has value + zeros so far - ones so far, its own included. None if there is no way."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {(0, 0): (0, -1, -1)}
    for z in range(zeros):
        for o in range(ones):
            if (z, o) not in best:
                continue
            base = best[z, o][0]
            for dz in range(1, zeros - z + 1):
                if value + z + dz - o - 1 >= tau:
                    break
                for do in range(1, ones - o + 1):
                    if not negative and value + z + dz - o - do < 0:
                        break
                    at, c = (z + dz, o + do), base + cost(dz, do)
                    if at not in best or c < best[at][0]:
                        best[at] = (c, z, o)
    if (zeros, ones) not in best:
        return None
    out, at = [], (zeros, ones)
    while at != (0, 0):
        _, z, o = best[at]
        out.append((at[0] - z, at[1] - o))
        at = (z, o)
    return out[::-1]


class Band:
    """Cheapest run pairs for all windows that begin at one value, where no value falls below 0.

    Values stay within 0 .. tau - 1, so for each number of zeros there are at most tau
    numbers of ones, and a pair has at most tau zeros: the table grows with the zeros of
    the longest window only, and holds the least cost for every window, however long.
    """

    def __init__(self, value: int, tau: int, cost: Callable[[int, int], int]) -> None:
        self.value, self.tau, self.cost = value, tau, cost
        self.costs: dict[tuple[int, int], int] = {}
        self.rows: list[dict[int, tuple[int, int, int]]] = [{value: (0, -1, -1)} if 0 <= value < tau else {}]

    def _extend(self) -> None:
        """The next number of zeros: value of the last one to cost, zeros and value before the last pair."""
        z, tau, costs, row = len(self.rows), self.tau, self.costs, {}
        for before in range(max(0, z - tau), z):
            dz = z - before
            for v, (base, _, _) in self.rows[before].items():
                if v + dz - 1 >= tau:
                    continue
                for do in range(max(1, v + dz - tau + 1), v + dz + 1):
                    if (dz, do) not in costs:
                        costs[dz, do] = self.cost(dz, do)
                    c, to = base + costs[dz, do], v + dz - do
                    if to not in row or c < row[to][0]:
                        row[to] = (c, before, v)
        # fewer ones first, the order in which equal costs are decided
        self.rows.append({v: row[v] for v in sorted(row, reverse=True)})

    def total(self, zeros: int, ones: int) -> int | None:
        while len(self.rows) <= zeros:
            self._extend()
        found = self.rows[zeros].get(self.value + zeros - ones)
        return found and found[0]

    def pairs(self, zeros: int, ones: int) -> list[tuple[int, int]] | None:
        if self.total(zeros, ones) is None:
            return None
        out, z, v = [], zeros, self.value + zeros - ones
        while z:
            _, before, u = self.rows[z][v]
            out.append((z - before, u + z - before - v))
            z, v = before, u
        return out[::-1]


def greedy_pairs(zeros: int, ones: int, value: int, tau: int, cost: Callable[[int, int], int]) -> list[tuple[int, int]] | None:
    """Run pairs where values below 0 are allowed: from the end, the pair with the most bits for each bit of code, until
    the rest can be searched whole. Each rest is at least a zero and a one and ends below tau, so there is a way for it."""
    if value >= tau or value + zeros - ones >= tau:
        return None
    out = []
    while zeros * ones > MAX_GRID:
        best, pair = 0.0, (zeros, ones)
        for j in range(max(1, value + zeros - tau), ones):
            for i in range(1, min(zeros - 1, tau - 1 - value + j) + 1):
                ratio = (zeros - i + ones - j) / cost(zeros - i, ones - j)
                if ratio > best:
                    best, pair = ratio, (zeros - i, ones - j)
        out.append(pair)
        zeros, ones = zeros - pair[0], ones - pair[1]
        if not zeros:
            return out[::-1]
    rest = best_window(zeros, ones, value, tau, True, cost)
    return rest and rest + out[::-1]


def permute(bits: str, tau: int, scheme: str = "diff", negative: bool = False, threshold: int = 8, memo: dict | None = None) -> str:
    """The bit form with every window permuted for the least cost; with negative, windows over MAX_GRID for less, if greedy steps find less.

    memo is kept from call to call with the same arguments but bits.
    """
    cost = pair_cost(scheme, threshold)
    out, window = [], []
    memo = {} if memo is None else memo
    value, before = 1, None  # value of the last one; of the last one that reaches tau

    def least(zeros: int, ones: int, start: int) -> list[tuple[int, int]] | None:
        """Run pairs with these sums after the value start; None if there is no way."""
        if not negative:
            if start not in memo:
                memo[start] = Band(start, tau, cost)
            return memo[start].pairs(zeros, ones)
        key = (zeros, ones, start)
        if key not in memo:
            memo[key] = greedy_pairs(*key, tau, cost)
        return memo[key]

    def close(end: bool = False) -> None:
        """Write the bits since the last kept one, permuted from the first zero to the last one.

        Before the first kept one, ones that lead may come in too, and after the last kept
        one (end) zeros that trail, if that costs less.
        """
        text = "".join(window)
        window.clear()
        first, last = text.find("0"), text.rfind("1")
        if first < 0 or last < first:
            out.append(text)
            return
        start = 1 if before is None else before
        lowest, new = sum(cost(len(z), len(o)) for z, o in re.findall("(0+)(1+)", text)) + 1, text
        for left in dict.fromkeys((first, 0)) if before is None else (first,):
            for more in range(min(len(text) - last - 1, tau - 1 - value) + 1 if end else 1):
                right = last + 1 + more
                pairs = least(text.count("0", left, right), text.count("1", left, right), start - left)
                if pairs and (c := sum(cost(*p) for p in pairs)) < lowest:
                    lowest, new = c, text[:left] + "".join("0" * z + "1" * o for z, o in pairs) + "0" * (len(text) - right)
        out.append(new)

    for part in bits.split("1")[:-1]:
        value += len(part) - 1
        if value >= tau:
            window.append(part)
            close()
            out.append("1")
            before = value
        else:
            window.append(part + "1")
    window.append(bits[bits.rfind("1") + 1 :])
    close(end=True)
    return "".join(out)


def _permuter(tau: int, scheme: str, negative: bool, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            new = [permute(x, tau, scheme, negative, threshold, memo) if x else x for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "permuted"])

    return run


def compress(bits: DataFrame, keys: Sequence[str], tau: int, scheme: str = "diff", negative: bool = False, threshold: int = 8) -> DataFrame:
    """keys, bits, permuted. The contract holds for every scheme: equal numbers of zeros and ones; values from tau on stay."""
    pair_cost(scheme, threshold)
    source = bits.select(*keys, "bits")
    schema = ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys), "bits string, permuted string"])
    return source.mapInArrow(_permuter(tau, scheme, negative, threshold), schema)


def changed(permuted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_changed: places where the bits differ."""
    same = F.size(F.filter(F.arrays_zip(F.split("bits", "").alias("x"), F.split("permuted", "").alias("y")), lambda z: z["x"] != z["y"]))
    return permuted.select(*keys, same.cast("long").alias("n_changed"))


def windows(ms: DataFrame, keys: Sequence[str], tau: int, part: str = "all") -> DataFrame:
    """keys, window, first, last, zeros: the values below tau between two that reach it, and the zeros written before them and before the next.

    Window 0 is the one before the first value that reaches tau; the one after the last such
    value has the zeros up to the end. part: inner (with such a value on both sides), ends, all.
    """
    if part not in ("inner", "ends", "all"):
        raise ValueError("part must be inner, ends or all")
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = ms.withColumns({"__z": F.col("ms") - F.lag("ms", 1, 1).over(w) + 1, "__k": (F.col("ms") >= tau).cast("int")})
    rows = rows.withColumns({"window": F.sum("__k").over(w) - F.col("__k"), "__all": F.sum("__k").over(Window.partitionBy(*keys))})
    inner = (F.col("window") > 0) & (F.col("window") < F.col("__all"))
    rows = rows.filter({"inner": inner, "ends": ~inner, "all": F.lit(True)}[part])
    # a vector of n values has 2n bits, so a last value of 0 leaves a zero after it
    trail = F.when(F.max("window") == F.max("__all"), F.greatest(F.lit(0), 1 - F.max_by("ms", "pos"))).otherwise(0)
    found = rows.groupBy(*keys, "window").agg(F.min(F.when(F.col("__k") == 0, F.col("pos"))).alias("first"), F.max(F.when(F.col("__k") == 0, F.col("pos"))).alias("last"), (F.sum("__z") + trail).cast("long").alias("zeros"))
    return found.filter("first is not null")
