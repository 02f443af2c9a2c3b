"""Sizes and stream bins of the frequent-item summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import check_fraction


def sample_size(phi: float) -> int:
    """Reservoir size m = ceil(1/phi)."""
    check_fraction(phi=phi)
    return math.ceil(1 / phi)


def sticky_rate(phi: float, epsilon: float, delta: float) -> float:
    """r = ln(1/(delta*phi))/epsilon: bin 0 holds the first 2r positions, bin k the next 2^k*r."""
    check_fraction(phi=phi, epsilon=epsilon, delta=delta)
    rate = math.log(1 / (delta * phi)) / epsilon
    if rate < 1:
        raise ValueError(f"phi, epsilon and delta give r = {rate!r}; r >= 1 is required")
    return rate


def stream_bin(t: Column, rate: float) -> Column:
    """Bin of position ``t``: the largest k with 2^k * r <= t, or 0 below 2r.

    The logarithm can be off by one beside a boundary, so it is compared with
    the exact boundaries on both sides.
    """
    guess = F.floor(F.log2(t / F.lit(rate)))
    start = F.lit(rate) * F.pow(F.lit(2.0), guess.cast("double"))
    exact = guess - (t < start).cast("bigint") + (t >= start * 2).cast("bigint")
    return F.when(t < F.lit(2 * rate), F.lit(0)).otherwise(exact).cast("int")


def bin_of(t: int, rate: float) -> int:
    """Driver-side twin of :func:`stream_bin` for one position."""
    k = 0
    while t >= 2 * rate * 2.0**k:
        k += 1
    return k
