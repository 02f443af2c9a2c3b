"""Mixing of sources to target weights by Pfair scheduling.

The documents of a source, in the order of a hash, are cut into blocks of equal
size in characters. Block k of a source of weight w is released at (k - 1) / w
and due at k / w, in slots; one block is scheduled per slot, of those released
the one that is due first. As the weights of a schedule sum to 1, every block
meets its deadline, and at any time each source has had its share to within
less than one block. When a source has no blocks left the others go on by their
weights among each other, so every document is placed exactly once.

Releases and deadlines are those of the exact weights, in whole numbers, so the
bound holds however many slots there are. The driver works the schedule out once
(a few microseconds and 8 bytes for each block) and sends the slots of the blocks
to the tasks.

Defined cases: without weights, a source's is its size to the power
``TEMPERATURE``; null is a source like others; a source without a weight, or
with weight 0, comes after all others; sources without characters take their
first slots at no cost of space; null texts count as empty; repeated rows and
documents of equal hash are placed in the order of their ids and texts; an empty
table gives no rows; other columns stay.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..plans import stage
from ..plans.skew import BROADCAST_ROWS
from .common import free_names, map_rows, table, tidy

TEMPERATURE = 0.7
BLOCK_CHARS = 100_000
#: The driver works out a schedule for each set of sources that still have blocks.
MAX_SOURCES = 2_000
SEED = 1


def shares(weights: list[float], period: int) -> list[int]:
    """Whole blocks of a period, one at least for each weight, by largest remainders."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    found = [max(1, int(x)) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: int(exact[k]) - exact[k])[: max(0, period - sum(found))]:
        found[k] += 1
    while sum(found) > period:
        k = max(range(len(found)), key=lambda k: (found[k] > 1, found[k] - exact[k], found[k]))
        found[k] -= 1
    while sum(found) < period:
        found[max(range(len(found)), key=lambda k: exact[k] - found[k])] += 1
    return found


def earliest_first(blocks: list[int], weights: list[int]) -> list[np.ndarray]:
    """Slots of each source's blocks, earliest deadline first among the released, until a source has no blocks left."""
    total = sum(weights)
    slots = [array("q") for _ in blocks]
    waiting = [(0, s) for s in range(len(blocks))]  # release, source
    ready: list[tuple[int, int]] = []  # deadline, source
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(slot)
        slot += 1
        done = len(slots[s])
        if done == blocks[s]:
            return [np.array(x, dtype=np.int64) for x in slots]
        heapq.heappush(waiting, (done * total // weights[s], s))


def one_period(counts: list[int]) -> list[np.ndarray]:
    """Slots of each source's blocks in a period of ``sum(counts)`` slots."""
    slots = earliest_first([c + 1 for c in counts], counts)
    return [own[own < sum(counts)] for own in slots]


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*[x.denominator for x in exact])
    return [int(x * common) for x in exact]


def schedule(blocks: Mapping, weights: Mapping) -> dict:
    """For each source, stretches ``(first block, first slot, slots from there, slots of the stretch)``, by first block.

    ``blocks`` has the number of blocks of each source. A stretch ends when a source has no blocks left.
    """
    if len(blocks) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: choose coarser ones")
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(blocks, 0)
    found: dict = {s: [] for s in blocks}
    now = 0
    while left:
        weighted = [s for s in left if weights.get(s, 0) > 0]
        active = sorted(weighted or left, key=lambda s: (s is not None, s))
        shares = whole([weights[s] if weighted else left[s] for s in active])
        slots = dict(zip(active, earliest_first([left[s] for s in active], shares)))
        length = sum(map(len, slots.values()))
        for s in active:
            if len(slots[s]):
                found[s].append((done[s], now, slots[s], length))
            done[s] += len(slots[s])
            left[s] -= len(slots[s])
            if not left[s]:
                del left[s]
        now += length
    return found


def _running(df: DataFrame, key: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the key before this one. For narrow rows.

    Rows are range partitioned by key and order and summed up inside each partition; one row for each
    key and partition gives the offsets. A key may hold any share of the rows.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} long, _part int").fields])
    at, size_at = df.columns.index(key), df.columns.index(amount)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, total = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            before = []
            for value, size in zip(batch.column(at).to_pylist(), batch.column(size_at).to_pylist()):
                if (value,) != current:
                    current, total = (value,), 0
                before.append(total)
                total += size
            columns = [*batch.columns, pa.array(before, pa.int64()), pa.array([part] * len(before), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name, "_part"])

    rows = stage(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(tidy(run), schema))
    sums = rows.groupBy(key, "_part").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def assign(
    docs: DataFrame,
    weights: Mapping | None = None,
    block_chars: int = BLOCK_CHARS,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, source, text_hash, chars, start, block, slot)`` of documents ``(doc_id, text, source)``.

    ``start`` is the number of characters of the source before the document, ``slot`` the place of its
    block in the mix: the mix is read in the order of slot and start.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.length(text).cast("long").alias("chars"))
    narrow = narrow.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = stage(_running(narrow, "source", ["_h", "doc_id", "text_hash"], "chars", "start").drop("_h"))
    sizes = {r["source"]: r["chars"] for r in rows.groupBy("source").agg(F.sum("chars").alias("chars")).limit(MAX_SOURCES + 1).collect()}
    weights = {s: max(n, 1) ** temperature for s, n in sizes.items()} if weights is None else weights
    found = schedule({s: max(1, -(-n // block_chars)) for s, n in sizes.items()}, weights)

    def start():
        def run(batch):
            block = np.array(batch["start"], dtype=np.int64) // block_chars
            slot = np.zeros(len(block), dtype=np.int64)
            numbers = {source: k for k, source in enumerate(found)}
            sources = np.array([numbers[s] for s in batch["source"]])
            for source in set(batch["source"]):
                at = np.flatnonzero(sources == numbers[source])
                stretches = found[source]
                # An empty document at the very end starts behind the last block.
                own = np.minimum(block[at], max(1, -(-sizes[source] // block_chars)) - 1)
                block[at] = own
                which = np.searchsorted([s[0] for s in stretches], own, side="right") - 1
                for k in np.unique(which):
                    first, now, slots, _ = stretches[k]
                    slot[at[which == k]] = now + slots[own[which == k] - first]
            return batch | {"block": block, "slot": slot}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, text_hash long, chars long, start long, block long, slot long"
    return map_rows(rows.withColumn("source", F.col("source").cast("string")), schema, start)


def mixed(docs: DataFrame, weights: Mapping | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, with all columns, in the order of the mix: by partitions and inside each of them."""
    places = stage(assign(docs, weights, block_chars))
    keyed = places.groupBy("doc_id", "text_hash").agg(F.min(F.struct("slot", "start")).alias("_place"))
    id_, hash_, slot, start = free_names(docs, "_id", "_hash", "_slot", "_start")
    keyed = keyed.select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("_place.slot").alias(slot), F.col("_place.start").alias(start)
    )
    # Texts are moved once, to their place in the mix, while the places can be sent to all tasks.
    keyed = F.broadcast(keyed) if places.count() <= 5 * BROADCAST_ROWS else keyed
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    placed = docs.join(keyed, same)
    ordered = placed.repartitionByRange(slot, start, "doc_id").sortWithinPartitions(slot, start, "doc_id")
    return ordered.select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).drop("text_hash")
