"""Repeatable random draws from md5, so that SQL in any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[part.cast("string") for part in parts]))


# Bits of a draw: more than any number of draws needs for its smallest probabilities.
BITS = 60


def word60(*parts: Column) -> Column:
    """Uniform 60-bit integer from the first fifteen hex digits of md5('a:b:...')."""
    return F.conv(F.substring(_digest(*parts), 1, 15), 16, 10).cast("bigint")


def leading_zero_bits(word: Column) -> Column:
    """Leading zero bits of a 60-bit word: a geometric(1/2) number of tails before the first head."""
    return F.when(word == 0, F.lit(BITS)).otherwise(F.lit(BITS) - F.length(F.bin(word)))


def sticky_coin(seed: int, item: Column, t: Column, stream_bin: Column) -> Column:
    """True with probability 2^-bin; no draw is spent on bin 0."""
    word = word60(F.lit(seed), F.lit("coin"), item, t)
    # word < 2^(60 - bin), in integers.
    shift = F.greatest(F.lit(BITS) - stream_bin.cast("int"), F.lit(0))
    return F.when(stream_bin == 0, F.lit(True)).otherwise(F.call_function("shiftright", word, shift) == 0)


def sticky_tau(seed: int, item: Column, stream_bin: Column) -> Column:
    return leading_zero_bits(word60(F.lit(seed), F.lit("tau"), item, stream_bin))


def reservoir_key(seed: int, t: Column) -> Column:
    """Random rank of stream position ``t``; the m smallest form a uniform m-sample."""
    return word60(F.lit(seed), F.lit("res"), t)


def reservoir_tie(seed: int, t: Column) -> Column:
    """Order of equal ranks: the digits of the same md5 that the rank does not use."""
    return F.substring(_digest(F.lit(seed), F.lit("res"), t), 16, 17)
