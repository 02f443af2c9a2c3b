"""The item operators run one item at a time, with the same md5 draws."""

import hashlib
from collections import Counter

from lodestar.functions import bin_of, sample_size, sticky_rate


def word(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def sticky(items, phi, epsilon, delta, seed=42):
    rate, table, current = sticky_rate(phi, epsilon, delta), {}, 0
    for t, item in enumerate(items):
        b = bin_of(t, rate)
        while current < b:
            current += 1
            for key in list(table):
                table[key] -= 60 - word(seed, "tau", key, current).bit_length()
                if table[key] <= 0:
                    del table[key]
        if item in table:
            table[item] += 1
        elif b == 0 or word(seed, "coin", item, t) >> (60 - b) == 0:
            table[item] = 1
    return sorted(table.items())


def reservoir(items, phi, seed=42):
    ranked = sorted((word(seed, "res", t), t, item) for t, item in enumerate(items))
    return ranked[: sample_size(phi)]


def true_items(items, phi):
    return sorted((i, n) for i, n in Counter(items).items() if n >= phi * len(items))
