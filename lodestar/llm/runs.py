"""Periodic runs of words, found by uniting suffix classes in the order of their common prefixes.

The suffixes of a text's words are sorted, and neighbours are united by
decreasing length of their longest common prefix (LCP), as Kruskal's algorithm
takes edges: at length l, the suffixes of a class agree on l words at least. Each
class keeps its positions in order. Where the positions of two classes become
neighbours at a distance p of at most l, the words from the first position on
have period p over p + l words: a seed. A run is found from its first word, where
no neighbour lies in between, so its seed has the smallest period, ends with the
run, and starts it if the word before breaks the period; all other seeds lie
inside runs and are left.

A run of ``LEAST`` words and ``TIMES`` periods agrees with itself over two thirds
of its length, so only classes of 16 words and more matter (``_reach``). A pass
over all texts of a batch finds the texts in which so many words repeat at all,
by hashes that can only say so too often; the rest have no runs.

Defined cases: a null text has no words, and neither has one of white space: no
runs, the hash of the empty text for both; runs may overlap and cross, each is
listed; ties of the greatest exponent go to the smaller start, then the smaller
period; rows are independent, so repeated rows and ids give repeated results; a
null id counts as the empty text where the id is hashed; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table
from .jaccard import mix

LEAST = 24
TIMES = 3
#: Positions of one piece of an ordered set.
PIECE = 1_024
#: Different words that a task remembers.
MEMO = 400_000


def _reach(least: int, times: int) -> int:
    """Words on which a run's suffixes at its start and one period later agree at least."""
    return least - least // times


class Positions:
    """An ordered set of positions, in pieces so that an insertion moves few of them."""

    __slots__ = ("pieces", "lasts", "size")

    def __init__(self, position: int):
        self.pieces, self.lasts, self.size = [[position]], [position], 1

    def put(self, x: int) -> tuple[int, int]:
        """Insert ``x``; its neighbours then, -1 where there is none."""
        at = bisect_left(self.lasts, x)
        if at == len(self.pieces):
            at -= 1
        piece = self.pieces[at]
        place = bisect_left(piece, x)
        before = piece[place - 1] if place else self.lasts[at - 1] if at else -1
        after = piece[place] if place < len(piece) else self.pieces[at + 1][0] if at + 1 < len(self.pieces) else -1
        piece.insert(place, x)
        self.size += 1
        if len(piece) > PIECE:
            half = len(piece) // 2
            self.pieces.insert(at + 1, piece[half:])
            del piece[half:]
            self.lasts.insert(at, piece[-1])
        self.lasts[at] = self.pieces[at][-1]
        self.lasts[-1] = self.pieces[-1][-1]
        return before, after

    def __iter__(self):
        return chain.from_iterable(self.pieces)


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; ``words`` are numbers."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        steps = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        if steps[-1] == n - 1:
            return order
        rank[order] = steps
        width *= 2
        if width >= n:
            return order


def neighbour_lcps(words: list[int], order: list[int]) -> list[int]:
    """For each place in the order after the first, how many words its suffix shares with the one before."""
    n = len(words)
    place = [0] * n
    for k, start in enumerate(order):
        place[start] = k
    found = [0] * n
    shared = 0
    for start in range(n):
        k = place[start]
        if k:
            other = order[k - 1]
            limit = n - max(start, other)
            while shared < limit and words[start + shared] == words[other + shared]:
                shared += 1
            found[k] = shared
            if shared:
                shared -= 1
        else:
            shared = 0
    return found


def runs_of(words: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period, of words given as numbers; ``times`` is 2 or more."""
    n = len(words)
    reach = max(1, _reach(least, times))
    if n < least or n <= reach:
        return []
    order = suffix_order(np.asarray(words)).tolist()
    words = list(words)
    lcps = neighbour_lcps(words, order)
    places = [k for k in range(1, n) if lcps[k] >= reach]
    places.sort(key=lcps.__getitem__, reverse=True)
    parent = list(range(n))
    classes: dict[int, Positions] = {}
    found = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def seed(x: int, y: int, shared: int) -> None:
        period = y - x
        if times * period <= period + shared >= least and not (x and words[x - 1] == words[y - 1]):
            found.append((x, period + shared, period))

    for k in places:
        shared = lcps[k]
        a, b = root(k - 1), root(k)
        large = classes.pop(a, None) or Positions(order[a])
        small = classes.pop(b, None) or Positions(order[b])
        if large.size < small.size:
            large, small = small, large
        parent[b] = a
        classes[a] = large
        # In ascending order: what follows a position is its neighbour only if the next of the smaller class is
        # not in between, and two that come into the same gap of the larger class were neighbours before.
        moved = list(small)
        for x, following, last in zip(moved, [*moved[1:], n], [-1, *moved]):
            before, after = large.put(x)
            if before >= 0 and before != last:
                seed(before, x, shared)
            if 0 <= after < following:
                seed(x, after, shared)
    return sorted(found, key=lambda run: (run[0], run[2]))


class Numbers(dict):
    """Words as numbers, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def repeating(sequences: list[np.ndarray], width: int) -> list[bool]:
    """Whether a window of so many words comes twice in a sequence; seldom true without need, never false in vain."""
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    if not sizes.sum():
        return [False] * len(sequences)
    flat = np.concatenate(sequences).astype(np.uint64)
    # Hashes of windows of doubling width, then two that overlap cover the whole width.
    hashes, reach = mix(flat + np.uint64(1)), 1
    while reach < width:
        step = min(reach, width - reach)
        longer = mix(hashes * np.uint64(0x9E3779B97F4A7C15))
        longer[: len(flat) - step] += hashes[step:] if step < len(flat) else hashes[:0]
        hashes, reach = mix(longer), reach + step
    owner = np.repeat(np.arange(len(sequences)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + width <= np.repeat(sizes, sizes)
    keys = mix(hashes[inside] + owner[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    owner = owner[inside]
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    twice = owner[1:][keys[1:] == keys[:-1]]
    found = np.zeros(len(sequences), dtype=bool)
    found[twice] = True
    return found.tolist()


def periodic_part(n: int, crc: int) -> tuple[int, int] | None:
    """Where and with which period the words of a document with this hash of its id are overwritten."""
    if crc % 10 or not n:
        return None
    g = crc // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:
        # Exponents compared as fractions.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, overwrite: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, best, collapsed)`` of documents ``(doc_id, text)``.

    ``runs`` is an array of ``(start, length, period)``, ``best`` the one of the greatest length in periods (or
    null), ``collapsed`` the words with each run cut to its first period. With ``overwrite`` a tenth of the texts, by the hash of their ids, is made periodic first.
    """
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"
    )
    reach = max(1, _reach(least, times))

    def start():
        memo = Numbers()

        def of_slice(ids, texts, out):
            split = []
            for doc_id, text in zip(ids, texts):
                words = (text or "").encode("utf-8", "replace").split()
                part = periodic_part(len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())) if overwrite else None
                if part is not None:
                    first, period = part
                    copies = -(-(len(words) - first) // period)
                    words[first:] = (words[first : first + period] * copies)[: len(words) - first]
                split.append(words)
            if len(memo) > MEMO:
                memo.clear()
            numbers = [np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words)) for words in split]
            for doc_id, words, own, maybe in zip(ids, split, numbers, repeating(numbers, reach)):
                runs = runs_of(own, least, times) if maybe else []
                if runs:
                    words = [words[k] for k in np.flatnonzero(collapsed(len(words), runs)).tolist()]
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(own))
                named = {run: dict(zip(("start", "length", "period"), run)) for run in runs}
                out["runs"].append(list(named.values()))
                out["best"].append(named.get(strongest(runs)))
                out["collapsed"].append(b" ".join(words).decode("utf-8"))

        def run(batch):
            out = {name: [] for name in ("doc_id", "n_words", "runs", "best", "collapsed")}
            for at in range(0, len(batch["doc_id"]), 256):
                of_slice(batch["doc_id"][at : at + 256], batch["text"][at : at + 256], out)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), schema, start)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), overwrite=True)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
