"""Joins of a large table with one row per key, safe when a few keys hold most rows.

A key is hot when it holds more than 1/10,000 of all rows. There can be at most
10,000 such keys however large the data is, so the hot part of the keyed table
may always be broadcast; every other key is small enough for a shuffled join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
# Below this many rows no key is worth treating as hot.
HOT_FLOOR = 1_000_000
# Keyed tables of at most this many rows (of some tens or hundreds of bytes) are broadcast.
BROADCAST_ROWS = 200_000


def hot_limit(total_rows: int, floor: int = HOT_FLOOR) -> int:
    return max(floor, math.ceil(total_rows / MAX_HOT_KEYS))


def join_sized(
    rows: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    size: str,
    total_rows: int,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Inner join; ``keyed[size]`` tells how many of the ``total_rows`` rows carry the key."""
    on = list(on)
    limit = hot_limit(total_rows, floor)
    if total_rows <= limit:
        return rows.join(keyed.drop(size), on)
    hot = F.broadcast(keyed.where(F.col(size) > limit).drop(size))
    cold = keyed.where(F.col(size) <= limit).drop(size)
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on))


def drop_hot(
    rows: DataFrame,
    all_keys: DataFrame,
    on: Sequence[str],
    size: str,
    total_rows: int,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Rows without those of hot keys, for joins that are known to want none of these."""
    limit = hot_limit(total_rows, floor)
    if total_rows <= limit:
        return rows
    hot = F.broadcast(all_keys.where(F.col(size) > limit).select(*on))
    return rows.join(hot, list(on), "left_anti")


def in_keys(
    rows: DataFrame,
    keys: DataFrame,
    on: Sequence[str],
    size: str,
    n_keys: int,
    all_keys: DataFrame,
    total_rows: int,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Rows whose key is among ``keys``, a part of ``all_keys`` (both one row per key, with ``size``).

    ``n_keys`` bounds the rows of ``keys``: within ``BROADCAST_ROWS`` no row is
    moved. Beyond, rows are shuffled by key, but those of hot keys, wanted or
    not, never are.
    """
    on = list(on)
    wanted = keys.select(*on)
    if n_keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), on, "left_semi")
    limit = hot_limit(total_rows, floor)
    if total_rows <= limit:
        return rows.join(wanted, on, "left_semi")
    hot = F.broadcast(keys.where(F.col(size) > limit).select(*on))
    rest = drop_hot(rows, all_keys, on, size, total_rows, floor).join(wanted, on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(rest)
