"""Exact Jaccard join of word n-gram sets by partitioning the universe of n-grams.

Two sets that link differ in few n-grams: in at most H, a quarter of the smaller
size. The universe is hashed into m segments, m > H for each band of sizes, so
that linked sets agree on at least m - H whole segments. One key for each
non-empty segment is exchanged once; only keys that several sets hold go on.

Which segments serve to find a pair is a matter of cost. A key that many sets of
different components share is too dear and is skipped; by the pigeonhole
principle a pair can then only be lost if both sets have too few segments left.
These sets, few, get the rest of their share otherwise: the one-deletion
neighbourhood of a cheap segment counts twice, then the least dear of the
skipped keys are used, then deeper neighbourhoods (short sets have one segment
and nothing else). So no cap loses a link; every candidate is verified exactly.

Equal sets are joined first and stand for all their documents. Components come
in rounds: sets that share a key are compared with the first holder of the key,
which ties large groups of near copies together at a cost in proportion to
their size; later rounds only look at pairs of different components. Where many
components share a key, its sets are dealt into blocks; a task compares two
blocks, whatever number of keys they share, and returns as many links as tie
their components together.

Hashes of 64 bits stand for n-grams and for whole sets (two sets of 10^10 would be taken for equal about
once or twice).

Defined cases: null texts, empty texts and texts of white space have no n-grams
and link with nothing; a text of fewer words than n is one n-gram; repeated rows
have equal sets and link; rows that share an id are documents of their own; a
document without an id links like any other but gives its name to no component
(a component without any id is null); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..plans import stage
from ..plans.skew import BROADCAST_ROWS, join_sized
from .common import ROWS, buckets, free_names, map_rows, table, tidy
from .components import components

WORDS = 5
PERCENT = 80
#: Pairs of different components up to which the pairs of a key are listed.
KEY_PAIRS = 64
#: And up to which its sets are compared in blocks; beyond, the key is too dear and neighbourhoods are used. The result is the same.
BLOCK_PAIRS = 1_000_000_000
#: Pairs of a key up to which blocks are compared at once, without another round of stars before.
STAR_PAIRS = 1_000_000
#: Sets and n-grams of a block (a larger set is a block of its own size).
BLOCK_SETS = 200
BLOCK_GRAMS = 200_000
#: Partners of a set that one task compares with it.
STAR_SETS = 512
#: Keys that one task of the exchange should get.
TASK_KEYS = 500_000
#: N-grams whose segments are worked out at once.
SEGMENT_GRAMS = 50_000
#: A key that so many sets of one batch hold is spread over tasks.
BATCH_HOT = 64
SPREAD = 64
#: Sets below this size have one segment.
SHORT = 12

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """64-bit hashes of words; remembers them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[3]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], memo: WordHashes, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each whole text; a text of fewer words is one n-gram."""
    words = [(text or "").encode("utf-8", "replace").translate(_LOWER).split() for text in texts]
    counts = np.array([len(w) for w in words])
    hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum()))
    words.clear()
    ends = np.cumsum(counts)
    total = mix(hashes + np.uint64(size))
    for k in range(1, min(size, len(total))):
        total[: len(total) - k] = mix(total[: len(total) - k] * _MULTIPLIERS[0] + hashes[k:])
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= size:
            found = np.sort(total[end - count : end - size + 1])
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        elif count:
            whole = mix(hashes[end - count : end - count + 1] + np.uint64(count))
            for k in range(1, count):
                whole = mix(whole * _MULTIPLIERS[0] + hashes[end - count + k : end - count + k + 1])
            sets.append(whole)
        else:
            sets.append(hashes[:0])
    return sets


Maker = Callable[[], Callable[[list], list[np.ndarray]]]


def shingle_maker() -> Callable[[list], list[np.ndarray]]:
    memo = WordHashes()
    return lambda texts: shingle_sets(texts, memo)


# Size bands


class Bands:
    """Bands of set sizes: a set links only within its band and with the next ones.

    ``differ[k]`` is H for pairs whose smaller set is in band k, ``parts[k]`` is m.
    """

    def __init__(self, largest: int):
        self.edges = [1]
        while self.edges[-1] <= largest * 100 // PERCENT + 1:
            self.edges.append(self.edges[-1] * 100 // PERCENT + 1)
        self.differ, self.parts = [], []
        for low, high in zip(self.edges, self.edges[1:]):
            differ = (high - 1) * (100 - PERCENT) // PERCENT
            self.differ.append(differ)
            self.parts.append(1 if high <= SHORT else differ + 3 + -(-differ * 15 // 100))
        self.edges = np.array(self.edges)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def roles(self, size: int) -> list[int]:
        """Bands whose segments a set of this size needs: those of its smaller partners and its own."""
        own = self.of(size)
        return [k for k in (own - 1, own) if k >= 0 and self.differ[k] > 0]

    @staticmethod
    def column(values: list[int], band: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), band.cast("int") + 1)


#: Bands up to any size that a set can have.
BANDS = Bands(1 << 40)


def _segments(tokens: list[np.ndarray], bands: list[int], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the non-empty segments of many sets: ``(key, set index, segment)``."""
    sizes = np.array([len(t) for t in tokens])
    # Sets that begin in the same stretch of n-grams go together.
    stretch = (np.cumsum(sizes) - sizes) // SEGMENT_GRAMS
    first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    found = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(tokens)]):
        keys, owner, segment = _segments_at_once(tokens[a:b], sizes[a:b], bands[a:b], parts)
        found.append((keys, owner + a, segment))
    keys, owner, segment = (np.concatenate(c) for c in zip(*found))
    return keys, owner, segment


def _segments_at_once(tokens: list[np.ndarray], sizes: np.ndarray, bands: list[int], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = parts[bands].astype(np.int64)
    base = np.concatenate([[0], np.cumsum(m)])
    flat = np.concatenate(tokens)
    place = np.repeat(base[:-1], sizes) + ((flat >> np.uint64(7)) % np.repeat(m, sizes).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(base[-1], dtype=np.uint64)
    np.add.at(sums, place, mix(flat))
    filled = np.flatnonzero(np.bincount(place, minlength=base[-1]))
    owner = np.repeat(np.arange(len(tokens)), m)[filled]
    segment = filled - base[owner]
    band = np.array(bands, dtype=np.uint64)[owner]
    keys = mix(sums[filled] + (segment.astype(np.uint64) * np.uint64(256) + band) * _MULTIPLIERS[2])
    return ((keys << np.uint64(8)) | band).view(np.int64), owner, segment


def _variants(tokens: np.ndarray, segment: int, band: int, deletions: int, other: int) -> list[int]:
    """Keys of what is left of a segment after so many deletions, for partners that delete ``other`` n-grams."""
    mixed = mix(tokens)
    whole = mixed.sum(keepdims=True, dtype=np.uint64)
    if deletions == 0:
        lefts = whole
    else:
        gone = np.array(list(combinations(range(len(tokens)), deletions)), dtype=np.int64)
        lefts = whole - mixed[gone].sum(axis=1, dtype=np.uint64)
    tag = np.uint64((segment * 256 + band) * 16 + other)
    return mix(lefts + mix(np.array([tag]))).view(np.int64).tolist()


# Stages of the join


def _digest(found: np.ndarray) -> int:
    return int(mix(np.array([found.sum(dtype=np.uint64)]))[0].view(np.int64))


#: Kinds of rows of the exchange, in its column ``salt``: from 1 on, keys spread over tasks.
_PLAIN, _MARK, _DOC, _UNNAMED, _FILLED = 0, -1, -2, -3, -4


def _exchange(docs: DataFrame, maker: Maker) -> DataFrame:
    """One pass over the texts, one exchange: ``(key, sid, salt, more)``, staged.

    Shared keys with their holders and, in ``more``, the first holder; documents (``key`` is the id) with
    their sizes; and for each set and band (``key``) the number of its non-empty segments.
    """
    parts = np.array(BANDS.parts)
    names = ["key", "sid", "salt", "more"]
    schema = "key long, sid long, salt int, more long"

    def batch_of(key, sid, salt, more) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sid, pa.int64()), pa.array(salt, pa.int32()), pa.array(more, pa.int64())], names=names)

    def emit(ids: list, tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sids = np.array([_digest(f) for f in tokens], dtype=np.int64)
        sizes = np.array([len(f) for f in tokens])
        unnamed = np.array([i is None for i in ids])
        yield batch_of([i or 0 for i in ids], sids, np.where(unnamed, _UNNAMED, _DOC), sizes)
        # Copies in the batch are dropped here.
        _, once = np.unique(sids, return_index=True)
        roles = [(int(k), band) for k in once for band in BANDS.roles(int(sizes[k]))]
        whole = [(k, band) for k, band in roles if parts[band] == 1]
        if whole:
            yield batch_of([band for _, band in whole], sids[[k for k, _ in whole]], np.full(len(whole), _FILLED), [1] * len(whole))
        roles = [(k, band) for k, band in roles if parts[band] > 1]
        if not roles:
            return
        keys, owner, _ = _segments([tokens[k] for k, _ in roles], [band for _, band in roles], parts)
        role_sids = sids[[k for k, _ in roles]]
        yield batch_of([band for _, band in roles], role_sids, np.full(len(roles), _FILLED), np.bincount(owner, minlength=len(roles)))
        holder = role_sids[owner]
        order = np.argsort(keys, kind="stable")
        keys, holder = keys[order], holder[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(first, append=len(keys))
        hot = count > BATCH_HOT
        salt = np.where(np.repeat(hot, count), 1 + holder % SPREAD, _PLAIN)
        yield batch_of(keys, holder, salt, np.zeros(len(keys), dtype=np.int64))
        if hot.any():
            # A mark tells where all others of the key meet that it is shared.
            marks = first[hot]
            yield batch_of(keys[marks], holder[marks], np.full(len(marks), _MARK), np.zeros(len(marks), dtype=np.int64))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = maker()
        ids, tokens, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = sets_of(part.column(1).to_pylist())
                ids += part.column(0).to_pylist()
                tokens += found
                held += sum(map(len, found))
                if held > 400_000:
                    yield from emit(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield from emit(ids, tokens)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, salts = [], [], []
        for batch in batches:
            key, sid, salt, more = (c.to_numpy() for c in batch.columns)
            other = salt < _MARK
            if other.any():
                yield batch_of(key[other], sid[other], salt[other], more[other])
            for column, values in ((keys, key), (sids, sid), (salts, salt)):
                column.append(values[~other])
        if not keys:
            return
        key = np.concatenate(keys)
        keys.clear()
        sid = np.concatenate(sids)
        sids.clear()
        salt = np.concatenate(salts)
        salts.clear()
        order = np.argsort(key, kind="stable")
        same = key[order]
        same = same[1:] == same[:-1]
        order = order[(np.append(same, False) | np.append(False, same)) | (salt[order] > 0)] if len(order) else order
        key, sid, salt = key[order], sid[order], salt[order]
        order = np.lexsort((salt == _MARK, sid, key))
        key, sid, salt = key[order], sid[order], salt[order]
        again = np.append(False, (key[1:] == key[:-1]) & (sid[1:] == sid[:-1]))[: len(key)]
        key, sid, salt = key[~again], sid[~again], salt[~again]
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(first, append=len(key))
        keep = (np.repeat(sizes > 1, sizes) & (salt != _MARK)) | (salt > 0)
        hub = np.repeat(sid[first], sizes)
        key, sid, hub = key[keep], sid[keep], hub[keep]
        for at in range(0, len(key), 250_000):
            piece = slice(at, at + 250_000)
            yield batch_of(key[piece], sid[piece], np.zeros(len(key[piece]), dtype=np.int32), hub[piece])

    # About one word in six characters, and six keys for ten words.
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = buckets(int(chars) // 10, TASK_KEYS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text").mapInArrow(tidy(rows_of), schema)
    dealt = rows.repartition(count, F.col("key"), F.greatest("salt", F.lit(0)))
    return stage(dealt.mapInArrow(tidy(shared), schema))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose sets link, staged.

    A row carries the set of ``b``; that of ``a`` comes once for a group of partners, so a hub of many is spread over tasks.
    """
    pairs = stage(pairs.select("a", "b").distinct())
    total = pairs.count()
    if not total:
        return pairs
    part = F.lit(0)
    dealt = pairs
    if total > STAR_SETS:
        # Only a hub of more partners than that has several groups.
        many = pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > STAR_SETS)
        many = many.select("a", F.ceil(F.col("c") / F.lit(STAR_SETS)).alias("_parts"))
        many = F.broadcast(many) if total <= STAR_SETS * BROADCAST_ROWS else many
        dealt = pairs.join(many, "a", "left")
        part = F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1)))
    dealt = dealt.select("a", part.cast("int").alias("part"), "b")
    hubs = dealt.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("sid"))
    wanted = dealt.select("a", "part", "b", F.col("b").alias("sid")).unionByName(hubs)
    # Each pair wants two sets at most.
    wanted = F.broadcast(wanted) if 4 * total <= BROADCAST_ROWS else wanted
    rows = sets.select("sid", "tokens").join(wanted, "sid").select("a", "part", "b", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            linked = []
            for a, part, b, data in zip(*[c.to_pylist() for c in batch.columns]):
                tokens = np.frombuffer(data, dtype=np.uint64)
                if b is None:
                    hub, own = (a, part), tokens
                    linked.append(False)
                    continue
                # A hub without tokens of its own has no partners to link with.
                x, y = (own, tokens) if hub == (a, part) else (tokens[:0], tokens)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return stage(rows.mapInArrow(tidy(run), "a long, b long"))


def _spanning_links(part: pa.Table) -> pa.Table:
    """Links between the sets of two blocks, or of one with itself, that tie their components together."""
    tokens = [np.frombuffer(t, dtype=np.uint64) for t in part["tokens"].to_pylist()]
    block, x, y = (part[c].to_numpy() for c in ("block", "x", "y"))
    sids, roots = part["sid"].to_pylist(), part["component"].to_pylist()
    sizes = np.array([len(t) for t in tokens])
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    _, column, held = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    # Only n-grams of several sets count; they are taken some thousand at a time.
    several = held[column] > 1
    column, owner = (np.cumsum(held > 1) - 1)[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)))
    step = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        inside = slice(*np.searchsorted(column, [at, at + step]))
        grid = np.zeros((len(tokens), step), dtype=np.float32)
        grid[owner[inside], column[inside] - at] = 1
        common += grid[left] @ grid[right].T
    linked = 100 * common >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - common)
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    found = []
    for i, j in zip(*np.nonzero(linked)):
        i, j = left[i], right[j]
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            parent[a] = b
            found.append((sids[i], sids[j]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that tie together the components of linked sets that share a key, staged.

    ``rows`` are ``(key, sid, n, component)``. A set is at home at the most frequent key it is tied to within two
    steps, so that sets that share many keys share their home; the sets of a home are dealt into blocks. Two blocks with
    a common key meet in one task, once; a set is sent as often as there are blocks it must be compared with.
    """
    rows = stage(rows.select("key", "sid", "n", "component").distinct())
    total = rows.count()
    if not total:
        return rows.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    labels = rows.groupBy("key").agg(F.count("*").alias("c")).withColumn("home", F.struct("c", "key"))
    for turn in range(2):
        if turn:
            labels = rows.join(homes.select("sid", "home"), "sid").groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("home"))
        homes = join_sized(rows, labels, ["key"], "c", total).groupBy("sid")
        homes = stage(homes.agg(F.max("home").alias("home"), F.first("n").alias("n"), F.first("component").alias("component")))
    homes = homes.withColumn("home", F.col("home.key"))
    # The largest component of a home has blocks of its own: these are not compared with each other.
    largest = homes.groupBy("home", "component").agg(F.count("*").alias("c"))
    largest = largest.groupBy("home").agg(F.sum("c").alias("c"), F.max_by("component", F.struct("c", "component")).alias("largest"))
    homes = join_sized(homes, largest, ["home"], "c", total).withColumn("in_largest", F.col("component") == F.col("largest"))
    homes = stage(homes.select("sid", "home", "in_largest", "n", "component"))
    parts = homes.groupBy("home", "in_largest").agg(F.count("*").alias("c"), F.sum("n").alias("_n"))
    parts = parts.withColumn("parts", F.ceil(F.greatest(F.col("c") / F.lit(BLOCK_SETS), F.col("_n") / F.lit(BLOCK_GRAMS))))
    placed = join_sized(homes, parts.drop("_n"), ["home", "in_largest"], "c", total)
    block = F.xxhash64("home", "in_largest", F.pmod(F.xxhash64("sid"), F.col("parts")))
    placed = stage(placed.select("sid", block.alias("block"), "n", "component"))

    met = rows.select("key", "sid").join(placed, "sid").groupBy("key", "block")
    met = stage(met.agg(*[f(c).alias(f"{c}_{name}") for c in ("n", "component") for name, f in (("least", F.min), ("most", F.max))]))
    x, y = met.alias("x"), met.alias("y")
    one = (F.col("x.component_least") == F.col("y.component_most")) & (F.col("x.component_most") == F.col("y.component_least"))
    sized = (F.col("x.n_most") * 100 >= F.col("y.n_least") * PERCENT) & (F.col("y.n_most") * 100 >= F.col("x.n_least") * PERCENT)
    meets = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.block") <= F.col("y.block")) & ~one & sized)
    meets = meets.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    sent = stage(meets).withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))).join(placed.drop("n"), "block")
    sent = sent.join(sets.select("sid", "tokens"), "sid").select("x", "y", "block", "sid", "component", "tokens")
    return stage(sent.groupBy("x", "y").applyInArrow(_spanning_links, "a long, b long"))


def _may_link(small: Column, large: Column) -> Column:
    return F.least(small, large) * 100 >= F.greatest(small, large) * PERCENT


def _agree(band: Column, n_a: Column, n_b: Column) -> Column:
    """Segments, empty ones included, on which two linked sets of these sizes agree at least."""
    return BANDS.column(BANDS.parts, band) - F.floor((n_a + n_b) * (100 - PERCENT) / (100 + PERCENT))


def _depths(weak: DataFrame, roles: DataFrame, lost: DataFrame) -> dict[int, int]:
    """How many deletions the allocation of some set of a band may need, by band."""
    band = F.col("band")
    h = BANDS.column(BANDS.differ, band)
    dear = F.coalesce("_dear", F.lit(0))
    known = weak.join(roles.select("sid", "band", "filled"), ["sid", "band"]).join(lost.select("sid", "band", "_dear"), ["sid", "band"], "left")
    deep = F.when(2 * (F.col("filled") - dear) + dear >= h + 1, F.lit(1)).otherwise(F.ceil((h + 1) / F.col("filled")))
    found = known.groupBy("band").agg(F.max(deep).alias("deep")).collect()
    return {r["band"]: max(2, int(r["deep"])) if r["deep"] > 1 else 1 for r in found}


#: Kinds of rows of the fallback.
_INDEX, _RAISE, _USE, _FIXED = 0, 1, 2, 3


def _fallback_rows(weak: DataFrame, sets: DataFrame, dear: DataFrame, depths: dict[int, int]) -> DataFrame:
    """What sets with too few cheap segments, ``weak`` (sid, band), can be found by, staged.

    ``dear`` are the skipped keys of these sets, ``(key, sid, band, n, price)``. Rows of ``_INDEX`` are neighbourhoods
    of all segments; those of ``_RAISE`` what a cheap segment probes with one deletion, and of ``_USE`` a skipped key,
    of which each set needs ``left``; those of ``_FIXED`` are needed in any case.
    """
    parts, differ = BANDS.parts, BANDS.differ
    level = {k: differ[k] if parts[k] == 1 else depths.get(k, 1) for k in range(len(parts))}
    names = ["key", "sid", "band", "segment", "n", "kind", "left", "price"]

    def start():
        def run(batch):
            out = {name: [] for name in names}

            def put(keys, *values):
                for key in keys:
                    for name, value in zip(names, (key, *values)):
                        out[name].append(value)

            for sid, band, data, prices in zip(batch["sid"], batch["band"], batch["tokens"], batch["prices"]):
                tokens = np.frombuffer(data, dtype=np.uint64)
                n, m, h = len(tokens), parts[band], differ[band]
                prices = {p["key"]: p["price"] for p in prices or []}
                where = ((tokens >> np.uint64(7)) % np.uint64(m)).astype(np.int64)
                inside = {int(s): tokens[where == s] for s in np.unique(where)}
                keys, _, segment = _segments([tokens], [band], np.array(parts))
                key_of = dict(zip(segment.tolist(), keys.tolist()))
                skipped = [s for s in inside if key_of[s] in prices]
                cheap = [s for s in inside if key_of[s] not in prices]
                # Cheap keys have been searched; each raise of one and each use of a skipped one adds one more.
                left = h + 1 - len(cheap)
                if m > 1 and left <= len(inside):
                    for s in cheap:
                        for gone in range(0, min(1, len(inside[s])) + 1):
                            for other in range(0, 2 - gone):
                                put(_variants(inside[s], s, band, gone, other), sid, band, s, n, _RAISE, left, 0.0)
                    for s in skipped:
                        put([key_of[s]], sid, band, s, n, _USE, left, prices[key_of[s]])
                else:
                    # Too few segments for that: all go as deep as it takes; short sets have one only.
                    deep = h if m == 1 else max(1, -(-(h + 1) // len(inside)) - 1)
                    for s, own in inside.items():
                        for gone in range(0, min(deep, len(own)) + 1):
                            for other in range(0, deep - gone + 1):
                                put(_variants(own, s, band, gone, other), sid, band, s, n, _FIXED, 0, 0.0)
                # Any partner may delete as much as its allocation says.
                for s in range(m):
                    own = inside.get(s, tokens[:0])
                    for gone in range(0, min(level[band], len(own)) + 1):
                        put(_variants(own, s, band, gone, gone), sid, band, s, n, _INDEX, 0, 0.0)
            return out

        return run

    priced = dear.groupBy("sid", "band").agg(F.collect_list(F.struct("key", "price")).alias("prices"))
    rows = weak.join(sets, "sid").join(priced, ["sid", "band"], "left").select("sid", "band", "tokens", "prices")
    # A set of the weak ones has some hundred rows here at most times: they are made by all cores.
    rows = rows.repartition(F.col("sid"))
    return stage(map_rows(rows, "key long, sid long, band int, segment int, n long, kind int, left int, price double", start))


def _fallback(rows: DataFrame, dear: DataFrame, sets: DataFrame, found: DataFrame, joined: Callable) -> DataFrame:
    """Components ``found`` with what the rows of the fallback add."""
    kind = F.col("kind")
    index = rows.where(kind == _INDEX).select("key", "sid", "n")
    # The allocation: of each set's raises and skipped keys, those that meet the fewest rows.
    each = ["sid", "band", "segment"]
    met = index.groupBy("key").agg(F.count("*").alias("_c"))
    raises = rows.where(kind == _RAISE)
    prices = raises.join(met, "key", "left").groupBy(*each, "left").agg(F.sum(F.coalesce("_c", F.lit(0))).cast("double").alias("price"))
    prices = prices.unionByName(rows.where(kind == _USE).select(*each, "left", "price"))
    cheapest = F.row_number().over(Window.partitionBy("sid", "band").orderBy("price", "segment"))
    chosen = stage(prices.withColumn("_rank", cheapest).where(F.col("_rank") <= F.col("left")).select(*each))
    probes = raises.join(chosen, each, "left_semi").unionByName(rows.where(kind == _FIXED)).select("key", "sid", "n")
    probes = stage(probes.join(met.select("key"), "key", "left_semi"))
    used = rows.where(kind == _USE).join(chosen, each, "left_semi").select("key", "sid", "n")

    # First each probe with one holder of its key: that ties together what is alike.
    hub = index.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("_h"))
    star = probes.join(hub, "key").where((F.col("sid") != F.col("_h.sid")) & _may_link(F.col("n"), F.col("_h.n")))
    star = star.select(F.least("sid", "_h.sid").alias("a"), F.greatest("sid", "_h.sid").alias("b")).distinct()
    more = _verified(_apart(star, found), sets)
    if more.limit(1).count():
        found = joined(found, more)
    # Then all sets of different components that still share a key.
    index = index.join(probes.select("key"), "key", "left_semi")
    again = dear.join(used.select("key"), "key", "left_semi").select("key", "sid", "n")
    rows = stage(_with_component(probes.unionByName(index).unionByName(again).distinct(), found))
    costs = stage(_key_costs(rows))
    more = _block_links(rows.join(costs.where(F.col("cross") > KEY_PAIRS), "key", "left_semi"), sets)
    found = joined(found, more) if more.limit(1).count() else found
    rows = _with_component(rows.drop("component").join(costs.where(F.col("cross") <= KEY_PAIRS), "key", "left_semi"), found)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "component")]
    pairs = rows.select("key", *side("a")).join(rows.select("key", *side("b")), "key")
    pairs = pairs.where((F.col("sid_a") < F.col("sid_b")) & (F.col("component_a") != F.col("component_b")) & _may_link(F.col("n_a"), F.col("n_b")))
    more = _verified(pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")), sets)
    return joined(found, more) if more.limit(1).count() else found


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of different components."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("_a IS NULL OR _b IS NULL OR _a <> _b").select("a", "b")


def _with_component(keys: DataFrame, found: DataFrame) -> DataFrame:
    known = found.withColumnRenamed("node", "sid")
    return keys.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _band_of(n: Column) -> Column:
    """Band of a size, looked up among the few edges."""
    edges = F.array(*[F.lit(int(e)) for e in BANDS.edges])
    return F.size(F.filter(edges, lambda e: e <= n)) - 1


def _key_costs(keys: DataFrame) -> DataFrame:
    """Keys of several components: pairs of different components (``cross``) and the largest component."""
    parts = keys.groupBy("key", "component").agg(F.count("*").alias("_c"))
    c = F.col("_c").cast("double")
    costs = parts.groupBy("key").agg(
        ((F.sum("_c").cast("double") * F.sum("_c") - F.sum(c * c)) / 2).alias("cross"),
        F.max_by("component", F.struct("_c", "component")).alias("largest"),
    )
    return costs.where("cross > 0")


def _star_pairs(keys: DataFrame) -> DataFrame:
    """Each holder of a key with the first holder, where they share a good part of what linked sets must share."""
    pairs = keys.where("hub <> sid").groupBy(F.col("hub").alias("a"), F.col("sid").alias("b"), "band", "n")
    return pairs.agg(F.count("*").alias("_k")).where(F.col("_k") * 4 >= _agree(F.col("band"), F.col("n"), F.col("n")) - 4)


def _cross_pairs(keys: DataFrame, cheap: DataFrame, enough: bool, dear: DataFrame | None) -> DataFrame:
    """Pairs of different components that share a cheap key: with ``enough`` only those that share as many as linked sets must.

    ``dear`` counts the skipped keys of each set, ``(sid, band, _dear)``, which cannot be shared here.
    """
    rows = keys.join(cheap.select("key", "largest"), "key")
    if dear is not None:
        rows = rows.join(dear, ["sid", "band"], "left")
    skipped = F.coalesce("_dear", F.lit(0)) if dear is not None else F.lit(0)
    rows = rows.withColumn("_blank", F.col("_empty") + skipped if enough else F.lit(None).cast("long"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "component", "_blank")]
    few = rows.where("component <> largest").select("key", "band", *side("a"))
    every = rows.select("key", F.col("largest").alias("_l"), *side("b"))
    pairs = few.join(every, "key").where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("_l")) | (F.col("sid_a") < F.col("sid_b")))
        & _may_link(F.col("n_a"), F.col("n_b"))
        & (_band_of(F.least("n_a", "n_b")) == F.col("band"))
    )
    a, b = F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")
    need = _agree(F.col("band"), F.col("n_a"), F.col("n_b")) - F.least("_blank_a", "_blank_b")
    counted = pairs.groupBy(a, b).agg(F.count("*").alias("_k"), F.max(need).alias("_need"))
    return counted.where((F.col("_k") >= F.col("_need")) | F.col("_need").isNull()).select("a", "b")


def _sets_and_bands(exchanged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sid, n, first)`` of each set and ``(sid, n, first, band, filled, _empty)`` of its bands."""
    salt, more = F.col("salt"), F.col("more")
    document, filled = salt.isin(_DOC, _UNNAMED) & (more > 0), salt == _FILLED
    band = F.when(filled, F.col("key"))
    reps = stage(
        exchanged.where(document | filled)
        .groupBy("sid")
        .agg(
            F.min(F.when(document, more)).alias("n"),
            F.min(F.when(salt == _DOC, F.col("key"))).alias("first"),
            F.max(band).alias("own"),
            F.min(band).alias("below"),
            F.max(F.when(filled, F.struct("key", "more"))).alias("_o"),
            F.min(F.when(filled, F.struct("key", "more"))).alias("_b"),
        )
        .select("sid", "n", "first", "own", "below", F.col("_o.more").alias("_own"), F.col("_b.more").alias("_below"))
    )
    both = F.array(
        F.struct(F.col("own").cast("int").alias("band"), F.col("_own").alias("filled")),
        F.when(F.col("below") < F.col("own"), F.struct(F.col("below").cast("int").alias("band"), F.col("_below").alias("filled"))),
    )
    roles = reps.where("own IS NOT NULL").select("sid", "n", "first", F.explode(F.array_compact(both)).alias("_r"))
    roles = roles.select("sid", "n", "first", "_r.band", "_r.filled")
    return reps.select("sid", "n", "first"), roles.withColumn("_empty", BANDS.column(BANDS.parts, F.col("band")) - F.col("filled"))


def links(docs: DataFrame, exchanged: DataFrame, reps: DataFrame, roles: DataFrame, maker: Maker) -> DataFrame:
    """``(node, component)`` of digests of the sets that links connect, staged."""
    band = F.col("band")
    parts, differ = BANDS.column(BANDS.parts, band), BANDS.column(BANDS.differ, band)
    held = exchanged.where(F.col("salt") == _PLAIN).select(
        "key", F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("band"), "sid", F.col("more").alias("hub")
    )
    # A linked set agrees with its partner on m - H segments; each is empty or its key is shared.
    # A set has no more keys than a fraction of its n-grams, so its rows may meet in one group.
    held = held.repartition(F.col("sid")).withColumn("_k", F.count("*").over(Window.partitionBy("sid", "band")))
    able = held.join(roles, ["sid", "band"]).where(F.col("_k") + F.col("_empty") >= parts - differ)
    keys = stage(able.select("key", "band", "sid", "hub", "n", "_empty", "first"))
    # Sets that have too few non-empty segments from the start.
    bare = roles.where(F.col("filled") <= differ)
    chosen = stage(keys.select("sid", "first").unionByName(bare.select("sid", "first")).distinct())
    sets = stage(_tokens(docs, chosen, maker))

    def joined(known: DataFrame | None, more: DataFrame) -> DataFrame:
        """Components after further links."""
        old = [] if known is None else [known.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        return stage(components(reduce(DataFrame.unionByName, [more, *old])))

    found = joined(None, _verified(_star_pairs(keys), sets))
    # Only keys that several components hold matter from here on.
    current = _with_component(keys.drop("hub", "first"), found)
    several = current.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    keys = stage(current.join(several.select("key"), "key", "left_semi"))

    def costs_now(current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """``current``, its cheap keys, its dear ones and the most pairs of one of these (0 without any)."""
        costs = stage(_key_costs(current))
        dear = costs.where(F.col("cross") > KEY_PAIRS)
        return current, costs.where(F.col("cross") <= KEY_PAIRS), dear, dear.agg(F.max("cross")).first()[0] or 0

    current, cheap, dear, most = costs_now(keys)
    keys = keys.drop("component")
    if most > STAR_PAIRS:
        # Large groups that one round of stars has not tied together: once more, in another order.
        again = _verified(_reordered_star(current.join(dear.select("key"), "key", "left_semi")), sets)
        if again.limit(1).count():
            found = joined(found, again)
            current, cheap, dear, most = costs_now(stage(_with_component(keys, found)))
    lost = None
    if most:
        skipped = dear.select("key")
        dense = stage(dear.where(F.col("cross") <= BLOCK_PAIRS).select("key"))
        more = _block_links(current.join(dense, "key", "left_semi"), sets)
        if more.limit(1).count():
            found = joined(found, more)
        # These keys are done; what is not settled by the others needs fewer of them.
        lost = current.join(skipped, "key", "left_semi").groupBy("sid", "band").agg(F.count("*").alias("_dear"))
        keys = keys.join(dense, "key", "left_anti")
        current, cheap, dear, most = costs_now(stage(_with_component(keys, found)))
    more = _verified(_cross_pairs(current, cheap, True, lost), sets)
    while more.limit(1).count():
        found = joined(found, more)
        if not most:
            break
        before = dear
        current, cheap, dear, most = costs_now(stage(_with_component(keys, found)))
        freed = before.select("key").join(cheap, "key")
        if not freed.limit(1).count():
            break
        more = _verified(_cross_pairs(current, freed, False, None), sets)

    # What the cheap keys cannot guarantee.
    prices = current.join(dear.select("key", F.col("cross").cast("double").alias("price")), "key") if most else current.limit(0).withColumn("price", F.lit(0.0))
    lost = prices.groupBy("sid", "band").agg(F.count("*").alias("_dear"), F.first("_empty").alias("_empty"))
    weak = bare.select("sid", "band")
    if most:
        weak = weak.unionByName(lost.where(F.col("_dear") + F.col("_empty") >= parts - differ).select("sid", "band")).distinct()
    weak = stage(weak)
    if weak.limit(1).count():
        held_dear = prices.join(weak, ["sid", "band"]).select("key", "sid", "band", "n", "price")
        rows = _fallback_rows(weak, sets, held_dear, _depths(weak, roles, lost))
        found = _fallback(rows, held_dear, sets, found, joined)
    return found


def _reordered_star(keys: DataFrame) -> DataFrame:
    """Stars around the holder that comes first in the order of a hash."""
    first = keys.groupBy("key").agg(F.min_by(F.struct("sid", "n", "component"), F.xxhash64(F.lit(1), "sid")).alias("_f"))
    pairs = keys.join(first, "key").where((F.col("_f.component") != F.col("component")) & _may_link(F.col("_f.n"), F.col("n")))
    a, b = F.least("_f.sid", "sid").alias("a"), F.greatest("_f.sid", "sid").alias("b")
    counted = pairs.groupBy(a, b).agg(F.count("*").alias("_k"), F.first("band").alias("band"), F.first("_f.n").alias("n_a"), F.first("n").alias("n_b"))
    return counted.where(F.col("_k") * 4 >= _agree(F.col("band"), F.col("n_a"), F.col("n_b")) - 4)


def _tokens(docs: DataFrame, chosen: DataFrame, maker: Maker) -> DataFrame:
    """``(sid, n, tokens)`` of the chosen sets, read again from the first document of each."""

    def start():
        sets_of = maker()

        def run(batch):
            found = sets_of(batch["text"])
            return {"sid": [_digest(f) for f in found], "n": [len(f) for f in found], "tokens": [f.tobytes() for f in found]}

        return run

    # Texts are moved only where there are too many ids to be sent to all tasks.
    ids = chosen.select(F.col("first").alias("_first")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS * 5 else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select("text")
    # A document that is the first of a chosen set may share its id with others.
    rows = map_rows(texts, "sid long, n long, tokens binary", start, rows=ROWS)
    return rows.join(chosen.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _classes(docs: DataFrame, maker: Maker) -> DataFrame:
    """``(doc_id, sid, n, root, component_id)`` of all documents; ``root`` tells components apart, null without n-grams."""
    exchanged = _exchange(docs, maker)
    reps, roles = _sets_and_bands(exchanged)
    found = links(docs, exchanged, reps, roles, maker).withColumnRenamed("node", "sid")
    # Sets outside all links are named by their own documents.
    tied = found.join(reps.select("sid", "first"), "sid")
    names = tied.groupBy("component").agg(F.min("first").alias("name"))
    by_set = tied.join(names, "component").select("sid", F.col("component").alias("_root"), "name", F.lit(True).alias("_tied"))
    by_set = reps.select("sid", "first").join(by_set, "sid", "left")
    by_set = by_set.select(
        "sid",
        F.coalesce("_root", "sid").alias("root"),
        F.when(F.col("_tied"), F.col("name")).otherwise(F.col("first")).alias("component_id"),
    )
    named = exchanged.where(F.col("salt").isin(_DOC, _UNNAMED)).select(
        F.when(F.col("salt") == _DOC, F.col("key")).alias("doc_id"), "sid", F.col("more").alias("n")
    )
    empty = named.where("n = 0").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    rest = named.where("n > 0").join(by_set, "sid").select("doc_id", "sid", "n", "root", "component_id")
    return rest.unionByName(empty).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def classes(docs: DataFrame, maker: Maker = shingle_maker) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for documents ``(doc_id, text)`` with integer ids.

    ``maker()`` gives, once per task, the function from texts to their sets, sorted distinct 64-bit hashes.
    """
    return _classes(docs, maker).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, less those linked to another one that comes before them.

    Of the linked documents of a component one stays, that of the smallest id; of several with this id, the
    first by text. Documents without an id stay, and so does whatever links with nothing, also where it
    shares its id with others.
    """
    found = stage(_classes(docs, shingle_maker).where("doc_id IS NOT NULL"))
    repeated = stage(found.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct())
    few = lambda ids: F.broadcast(ids) if ids.count() <= 5 * BROADCAST_ROWS else ids
    if not repeated.limit(1).count():
        return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)
    shared = few(repeated)
    stay = docs.join(few(gone), "doc_id", "left_anti").join(shared, "doc_id", "left_anti")
    # An id does not tell its rows apart: their sets do, made again.
    sid, root, row = free_names(docs, "_sid", "_root", "_row")

    def start():
        sets_of = shingle_maker()
        return lambda batch: batch | {sid: [_digest(f) for f in sets_of(batch["text"])]}

    rows = map_rows(docs.join(shared, "doc_id", "left_semi"), StructType([*docs.schema.fields, StructField(sid, LongType())]), start, rows=ROWS)
    known = found.join(shared, "doc_id", "left_semi").select("doc_id", F.col("sid").alias(sid), F.col("root").alias(root), "component_id").distinct()
    known = known.withColumnRenamed("component_id", row)
    rows = rows.join(known, ["doc_id", sid])
    first = F.row_number().over(Window.partitionBy("doc_id", root).orderBy("text"))
    linked = rows.where(F.col(root).isNotNull() & (F.col(row) == F.col("doc_id"))).withColumn(row, first).where(F.col(row) == 1)
    parts = [stay, rows.where(F.col(root).isNull()), linked]
    return reduce(DataFrame.unionByName, [p.select(*docs.columns) for p in parts])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                 END AS grams FROM w),
t AS (SELECT doc_id, unnest(grams) AS gram FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT shared.a, shared.b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.grams) + len(y.grams) - n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(any_value(s.grams)) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id"""
