from .checks import (
    check_at_least,
    check_fraction,
    check_frequent_params,
    check_positive,
)
from .coins import leading_zero_bits, reservoir_key, reservoir_tie, sticky_coin, sticky_tau, word60
from .geometry import cell_index, cell_side, squared_distance
from .sketch import bin_of, sample_size, sticky_rate, stream_bin
from .text import tokens

__all__ = [
    "bin_of",
    "cell_index",
    "cell_side",
    "check_at_least",
    "check_fraction",
    "check_frequent_params",
    "check_positive",
    "leading_zero_bits",
    "reservoir_key",
    "reservoir_tie",
    "sample_size",
    "squared_distance",
    "sticky_coin",
    "sticky_rate",
    "sticky_tau",
    "stream_bin",
    "tokens",
    "word60",
]
