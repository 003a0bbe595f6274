"""Lengths of self-delimiting codes, and the codes themselves, for positive integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """Binary digits of x; 0 has none."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))


def delta_length(x: Column) -> Column:
    """The number's digits but the first, and twice the digits of their count less one."""
    n = bit_length(x)
    return n + 2 * bit_length(n) - 2


def gamma_length(x: Column) -> Column:
    return 2 * bit_length(x) - 1


def nibble_length(x: Column) -> Column:
    """Four bits for every three digits."""
    return 4 * F.ceil(F.greatest(F.lit(1), bit_length(x)) / 3)


def fibonacci_length(x: Column) -> Column:
    """One more than the place of the greatest Fibonacci number (1, 2, 3, 5, ...) up to x."""
    fib = [1, 2]
    while fib[-1] < 2**62:
        fib.append(fib[-1] + fib[-2])
    return F.size(F.filter(F.array(*(F.lit(f) for f in fib)), lambda f: f <= x)) + 1


def comma_length(x: Column, width: int = 2) -> Column:
    """Digits in base 2^width - 1, of width bits each, and a closing one."""
    base = 2**width - 1
    powers = [base**k for k in range(1, 64) if base**k < 2**62]
    return width * (2 + F.size(F.filter(F.array(*(F.lit(p) for p in powers)), lambda p: p <= x)))


def gamma_code(x: Column) -> Column:
    """As many zeros as further digits, then the digits."""
    return F.concat(F.repeat(F.lit("0"), bit_length(x) - 1), F.bin(x))


def delta_code(x: Column) -> Column:
    """The gamma code of the number of digits, then the digits but the first."""
    return F.concat(gamma_code(bit_length(x)), F.substring(F.bin(x), 2, 64))


def gamma_value(code: Column) -> Column:
    """The number that a gamma code stands for."""
    return F.conv(F.regexp_replace(code, "^0*", ""), 2, 10).cast("long")


def project(zeros: Column, ones: Column, base: int = 1, threshold: int = 0) -> Column:
    """A one-to-one recoding of a run of ones by how near it is to the run of zeros before it.

    With d = |ones - zeros|: runs near to zeros get small numbers in turns from below and
    above; beyond, the run keeps its length. Runs of zeros up to threshold are left as
    they are.
    """
    near = F.when(ones < zeros, 2 * (zeros - ones) + base - 1).when(ones < 2 * zeros, 2 * (ones - zeros) + base).otherwise(ones)
    return F.when(zeros <= threshold, ones).otherwise(near)
