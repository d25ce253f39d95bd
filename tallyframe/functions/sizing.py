"""Sizes of sketches from accuracy wishes; plain functions of the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Bits of a linear counter with one percent error for 1, 2 ... 9 times each power of ten from 100 on.
ONE_PERCENT_BITS = [
    5034, 5067, 5100, 5133, 5166, 5199, 5231, 5264, 5296,
    5329, 5647, 5957, 6260, 6556, 6847, 7132, 7412, 7688,
    7960, 10506, 12839, 15036, 17134, 19156, 21117, 23029, 24897,
    26729, 43710, 59264, 73999, 88175, 101932, 115359, 128514, 141441,
    154171, 274328, 386798, 494794, 599692, 702246, 802931, 902069, 999894,
    1096582,
]
#: Fixed values: (items, bits) beyond ten million.
ONE_PERCENT_FAR = [(10_000_000, 1096582), (50_000_000, 4584297), (100_000_000, 8571013), (120_000_000, 10112529)]

#: The best number of hash functions for so many bits an element.
BEST_K = [1, 1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 10, 11, 12, 12, 13, 14]
#: Published false-positive rates by bits an element (row) and hash functions (column, from 0).
RATES = [
    [1.0],
    [1.0, 1.0],
    [1.0, 0.393, 0.400],
    [1.0, 0.283, 0.237, 0.253],
    [1.0, 0.221, 0.155, 0.147, 0.160],
    [1.0, 0.181, 0.109, 0.092, 0.092, 0.101],
    [1.0, 0.154, 0.0804, 0.0609, 0.0561, 0.0578, 0.0638],
    [1.0, 0.133, 0.0618, 0.0423, 0.0359, 0.0347, 0.0364],
    [1.0, 0.118, 0.0489, 0.0306, 0.024, 0.0217, 0.0216, 0.0229],
    [1.0, 0.105, 0.0397, 0.0228, 0.0166, 0.0141, 0.0133, 0.0135, 0.0145],
    [1.0, 0.0952, 0.0329, 0.0174, 0.0118, 0.00943, 0.00844, 0.00819, 0.00846],
    [1.0, 0.0869, 0.0276, 0.0136, 0.00864, 0.0065, 0.00552, 0.00513, 0.00509],
    [1.0, 0.08, 0.0236, 0.0108, 0.00646, 0.00459, 0.00371, 0.00329, 0.00314],
    [1.0, 0.074, 0.0203, 0.00875, 0.00492, 0.00332, 0.00255, 0.00217, 0.00199, 0.00194],
    [1.0, 0.0689, 0.0177, 0.00718, 0.00381, 0.00244, 0.00179, 0.00146, 0.00129, 0.00121, 0.0012],
    [1.0, 0.0645, 0.0156, 0.00596, 0.003, 0.00183, 0.00128, 0.001, 0.000852, 0.000775, 0.000744],
]


def _between(x: int, low: tuple[int, int], high: tuple[int, int]) -> int:
    """The line through two points at x, up to the next whole number."""
    share = (x - low[0]) / (high[0] - low[0])
    return math.ceil(low[1] + (high[1] - low[1]) * share)


def linear_counting_bytes(most: int) -> int:
    """Bytes of a linear counter with about one percent error for up to ``most`` different items."""
    if most <= 0:
        raise ValueError(f"the number of items ({most}) must be positive")
    if most < 100:
        bits = ONE_PERCENT_BITS[0]
    elif most < 10_000_000:
        power = len(str(most)) - 1
        step = 10**power
        digit = most // step
        at = 9 * (power - 2) + digit - 1
        bits = _between(most, (digit * step, ONE_PERCENT_BITS[at]), ((digit + 1) * step, ONE_PERCENT_BITS[at + 1]))
    elif most > 120_000_000:
        bits = most // 12
    else:
        low, high = next((a, b) for a, b in zip(ONE_PERCENT_FAR, ONE_PERCENT_FAR[1:], strict=False) if most <= b[0])
        bits = _between(most, low, high)
    return -(-bits // 8)


def linear_counting_bytes_for(error: float, most: int) -> int:
    """Bytes of the smallest linear counter whose standard error for ``most`` items is at most ``error``."""
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    if most <= 0:
        raise ValueError("the number of items must be positive")

    def enough(bits: int) -> bool:
        t = most / bits
        if t > 700:
            return False
        return bits > max(1 / (error * t) ** 2, 5) * (math.exp(t) - t - 1)

    low, high = 1, 100_000_000
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return -(-low // 8)


def hll_bits_for_rsd(rsd: float) -> int:
    """log2 of the registers of a HyperLogLog with about that relative standard deviation."""
    return int(math.log2((1.106 / rsd) ** 2))


def hll_bits_for_accuracy(accuracy: float) -> int:
    return 2 * int(math.floor(math.log2(1.04 / (1 - accuracy)) + 0.5))


def check_bits(p: int, low: int = 4, high: int = 30) -> int:
    if not low <= p <= high:
        raise ValueError(f"log2 of the number of registers must lie in {low} ... {high}: {p}")
    return p


def adaptive_choice(most: int) -> tuple[str, int]:
    """Linear counting (bytes) below 4.25 million expected items, else adaptive counting with 2**16 registers."""
    if most <= 0:
        raise ValueError(f"the number of items ({most}) must be positive")
    return ("linear", linear_counting_bytes(most)) if most < 4_250_000 else ("adaptive", 16)


@dataclass(frozen=True)
class CountMin:
    """Rows, columns and seed of a count-min sketch with the error bounds these give."""

    depth: int
    width: int
    seed: int = 1
    eps: float = 0.0
    confidence: float = 0.0

    @staticmethod
    def of(depth: int, width: int, seed: int = 1) -> CountMin:
        if depth < 1 or width < 1:
            raise ValueError("depth and width must be positive")
        return CountMin(depth, width, seed, 2 / width, 1 - 2.0**-depth)

    @staticmethod
    def within(eps: float, confidence: float, seed: int = 1) -> CountMin:
        return CountMin(math.ceil(-math.log(1 - confidence) / math.log(2)), math.ceil(2 / eps), seed, eps, confidence)


@dataclass(frozen=True)
class Bloom:
    """Bits and hash functions of a Bloom filter."""

    bits: int
    hashes: int

    @staticmethod
    def per_element(elements: int, bits_each: int) -> Bloom:
        return Bloom(-(-(elements * bits_each + 20) // 64) * 64, best_k(bits_each))

    @staticmethod
    def within(elements: int, rate: float) -> Bloom:
        k, bits_each = bits_and_k(rate)
        return Bloom(-(-(elements * bits_each + 20) // 64) * 64, k)

    @staticmethod
    def always() -> Bloom:
        """The filter that says yes to everything: 64 bits, all of them set."""
        return Bloom(64, 1)


def best_k(bits_each: int) -> int:
    return BEST_K[min(bits_each, len(BEST_K) - 1)]


def bits_and_k(rate: float) -> tuple[int, int]:
    """(hash functions, bits an element) for a false-positive rate: the fewest bits, then the fewest functions.

    Above the table's range it is one function on two bits; below, eight on fifteen, the table's end.
    """
    if rate >= RATES[2][1]:
        return 1, 2
    if rate < RATES[15][8]:
        return 8, 15
    bits = next(b for b in range(2, 16) if RATES[b][BEST_K[b]] <= rate)
    return next(k for k in range(1, BEST_K[bits] + 1) if all(RATES[bits][j] <= rate for j in range(k, BEST_K[bits] + 1))), bits


def false_positive_rate(bits_each: float, k: int) -> float:
    return (1 - math.exp(-k / bits_each)) ** k


def loglog_alpha(k: int) -> float:
    """The constant of LogLog with 2**k registers, in closed form times the number of registers."""
    if k == 0:
        return 0.0
    m = 2**k
    # (gamma(-1/m) (1 - 2**(1/m)) / ln 2) ** -m, by logarithms; gamma(-1/m) = -m gamma(1 - 1/m)
    log = math.log(m) + math.lgamma(1 - 1 / m) + math.log(math.expm1(math.log(2) / m)) - math.log(math.log(2))
    return m * math.exp(-m * log) if m < 2**24 else m * 0.39701


def hll_alpha(p: int) -> float:
    m = 2**p
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(p, 0.7213 / (1 + 1.079 / m))
