"""Self-delimiting codes of positive integers as strings of 0 and 1, and their inverses, in plain Python."""

from __future__ import annotations

from collections.abc import Callable

_FIB = [1, 2]
while _FIB[-1] < 1 << 62:
    _FIB.append(_FIB[-1] + _FIB[-2])


def gamma(x: int) -> str:
    digits = f"{x:b}"
    return "0" * (len(digits) - 1) + digits


def delta(x: int) -> str:
    digits = f"{x:b}"
    return gamma(len(digits)) + digits[1:]


def nibble(x: int) -> str:
    """Groups of three digits, the highest first, each after a 1 if another group follows and a 0 if not."""
    digits = f"{x:b}"
    digits = digits.zfill(-(-len(digits) // 3) * 3)
    groups = [digits[i : i + 3] for i in range(0, len(digits), 3)]
    return "".join("1" + g for g in groups[:-1]) + "0" + groups[-1]


def fibonacci(x: int) -> str:
    """A 1 for each Fibonacci number of the greedy sum, the smallest first, and a 1 to end."""
    out = ["1"]
    for f in reversed([f for f in _FIB if f <= x]):
        out.append("1" if f <= x else "0")
        x -= f if f <= x else 0
    return "".join(reversed(out))


def comma(x: int, width: int = 2) -> str:
    """Digits in base 2^width - 1, of width bits each, and one more of ones."""
    base, out = (1 << width) - 1, []
    while x:
        x, r = divmod(x, base)
        out.append(f"{r:0{width}b}")
    return "".join(reversed(out)) + "1" * width


def read_gamma(bits: str, at: int) -> tuple[int, int]:
    """(value, place after it); so for all readers."""
    one = bits.index("1", at)
    end = 2 * one - at + 1
    return int(bits[one:end], 2), end


def read_delta(bits: str, at: int) -> tuple[int, int]:
    n, at = read_gamma(bits, at)
    return int("1" + bits[at : at + n - 1], 2), at + n - 1


def read_nibble(bits: str, at: int) -> tuple[int, int]:
    x = 0
    while True:
        x = x << 3 | int(bits[at + 1 : at + 4], 2)
        at += 4
        if bits[at - 4] == "0":
            return x, at


def read_fibonacci(bits: str, at: int) -> tuple[int, int]:
    end = bits.index("11", at)
    return sum(f for f, b in zip(_FIB, bits[at : end + 1]) if b == "1"), end + 2


def read_comma(bits: str, at: int, width: int = 2) -> tuple[int, int]:
    base, x = (1 << width) - 1, 0
    while (d := int(bits[at : at + width], 2)) < base:
        x = x * base + d
        at += width
    return x, at + width


CODERS: dict[str, tuple[Callable[[int], str], Callable[[str, int], tuple[int, int]]]] = {
    "gamma": (gamma, read_gamma),
    "delta": (delta, read_delta),
    "nibble": (nibble, read_nibble),
    "fibonacci": (fibonacci, read_fibonacci),
    "comma": (comma, read_comma),
}
