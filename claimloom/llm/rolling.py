"""Vectorised hashes over the bytes of many texts, and filters of hash keys with a bounded size."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = 0x9E3779B97F4A7C15
#: A filter takes at most 2 ** 28 bits, 32 MB, wherever it is sent.
MOST_BITS = 28


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class RangeHash:
    """Hashes of any ranges of one block of bytes, from prefix sums modulo 2 ** 64."""

    _up, _down = _powers(_ODD, 1), _powers(_ODD, 1)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(RangeHash._up):
            n = (len(data) // 2**18 + 1) * 2**18
            RangeHash._up, RangeHash._down = _powers(_ODD, n), _powers(pow(_ODD, -1, 2**64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _byte_values()[data]
        values *= self._up[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._down[starts])

    def windows(self, width: int) -> np.ndarray:
        """One hash for each window of ``width`` bytes."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * self._down[:n])


class KeyFilter:
    """Tells for 64-bit keys whether they may be in a set; never denies a member."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        low, high = keys & np.uint64(2**self.bits - 1), keys >> np.uint64(64 - self.bits)
        return (self._bit(low) & self._bit(high)).astype(bool)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)


def key_filter(keys: DataFrame, each: int = 16, most_bits: int = MOST_BITS) -> KeyFilter:
    """The filter of a staged table's column ``key`` (long): ``each`` bits a key, up to 2 ** ``most_bits``.

    Spark gathers the bits as 64-bit words, so at most 2 ** (most_bits - 6) rows reach the driver.
    Beyond the most it lets more through, which costs work and changes no result.
    """
    bits = max(12, min(most_bits, math.ceil(math.log2(each * max(1, keys.count())))))
    places = F.explode(F.array(F.col("key").bitwiseAND(F.lit(2**bits - 1)), F.shiftrightunsigned("key", 64 - bits)))
    word, bit = F.shiftright("at", 6), F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = keys.select(places.alias("at")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("value")).toArrow()
    words = np.zeros(2 ** (bits - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return KeyFilter(bits, words)
