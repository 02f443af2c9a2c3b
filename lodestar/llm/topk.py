"""Exact top-k search by inner product, with sorted lists that are read in order and never at random.

The rows are dealt into shards. A shard keeps a sorted list of the values of
each component; a query reads the lists in step, each from the end that is good
for it. What it has read of a row bounds the row's score: from below with the
worst value of each list it has not met the row in, from above with the value
at which the reading stands. A row whose upper bound is below the k-th lower
bound, or below the k-th final score so far, is out, rows that no list has shown
yet among them. When the reading ends, the scores of the few rows that are left
are resolved exactly. The best k of each shard meet in a second exchange.

All queries of a batch read to the same depths, so the bounds of a batch and a
block of rows are matrix products. Every row goes to one shard, a query to all:
the exchange carries each row once and each query once for every ``SHARD_ROWS``
rows. Bounds and scores are exact: sums below 2^53 in double, else bounds are
widened and the final scores are whole numbers of any size.

Defined cases: vectors that are null or hold null or a component that is not
finite take no part, nor do rows without an id; vectors meet those of the same
length only (an empty vector scores 0 with another one); repeated rows are
queries and candidates of their own, only the query's own row is left out; ties
go to the smaller id; with fewer candidates than ``k`` all are returned; scores
beyond 64 bits end at the largest or smallest of these; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Rows of a shard, at most about; a small table is cut into shards of ``LEAST_ROWS`` for the sake of even work.
SHARD_ROWS = 200_000
LEAST_ROWS = 8_192
#: Rows and queries whose bounds are held at once.
BLOCK_ROWS = 512
BATCH_QUERIES = 256
#: Shares of the lists that are read before the rows that are left are resolved.
DEPTHS = (0.5, 0.75, 0.9)
#: Scores resolved at once.
PAIRS = 50_000
_LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """The sorted lists of a shard's rows of one length, as far as each reading goes."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.uids, self.rows = ids[order], uids[order], rows[order]
        n, width = rows.shape
        self.values = self.rows.astype(np.float64)
        largest = float(np.abs(self.values).max(initial=0))
        # Whole numbers up to here are exact in double, and so is every partial sum.
        self.largest, self.width = largest, width
        lists = np.sort(self.values, axis=0)
        reads = [min(n, max(1, round(n * share))) for share in DEPTHS]
        self.from_top = [lists[n - r] for r in reads]
        self.from_bottom = [lists[r - 1] for r in reads]
        self.least, self.most = lists[0], lists[-1]

    def slack(self, queries: np.ndarray) -> float:
        """How far double arithmetic may be from the exact bound."""
        size = max(1.0, self.width * self.largest * float(np.abs(queries).max(initial=0)))
        return 0.0 if size < 2.0**53 else size * 2.0**-44

    def scores(self, queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return np.einsum("ij,ij->i", queries, rows)
        whole = [sum(a * b for a, b in zip(q, r)) for q, r in zip(queries.tolist(), rows.tolist())]
        return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in whole], dtype=np.int64)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query index, id, score)`` of the best ``k`` rows for each query."""
        slack = self.slack(queries)
        plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        floor = np.full(len(queries), -np.inf)
        found = [np.zeros(0, dtype=np.int64) for _ in range(3)]
        for at in range(0, len(self.rows), BLOCK_ROWS):
            block = slice(at, at + BLOCK_ROWS)
            values, uids = self.values[block], self.uids[block]
            q, c = np.arange(len(queries)), np.arange(len(values))
            live = own[:, None] != uids[None, :]
            for top, bottom in zip(self.from_top, self.from_bottom):
                part, high, low = values[c], plus[q], minus[q]
                if np.isneginf(floor[q]).any() and live.shape[1] >= k:
                    lower = high @ np.where(part >= top, part, self.least).T + low @ np.where(part <= bottom, part, self.most).T
                    lower[~live] = -np.inf
                    floor[q] = np.maximum(floor[q], _within(np.partition(lower, -k, axis=1)[:, -k] - slack))
                upper = high @ np.maximum(part, top).T + low @ np.minimum(part, bottom).T
                live &= upper + slack >= floor[q][:, None]
                # Queries and rows that are done in this block are left out of the further reading.
                rows, columns = live.any(axis=1), live.any(axis=0)
                q, c, live = q[rows], c[columns], live[np.ix_(rows, columns)]
                if not live.size:
                    break
            mine, theirs = np.nonzero(live)
            mine, theirs = q[mine], c[theirs]
            for begin in range(0, len(mine), PAIRS):
                a, b = mine[begin : begin + PAIRS], theirs[begin : begin + PAIRS]
                score = self.scores(queries[a], self.rows[block][b], slack == 0)
                merged = [np.concatenate(x) for x in zip(found, (a, self.ids[block][b], score))]
                found, floor = _first(*merged, k, floor)
        return tuple(found)


def _within(floor: np.ndarray) -> np.ndarray:
    """Floors that keep the rows whose scores end at the limits of 64 bits: all of these are ties."""
    return np.where(floor < -9.2e18, -np.inf, np.minimum(floor, 9.2e18))


def _first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray):
    """The best ``k`` of each query, and the floors they give."""
    order = np.lexsort((ids, ~score, query))
    query, ids, score = query[order], ids[order], score[order]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    rank = np.arange(len(query)) - np.repeat(start, np.diff(start, append=len(query)))
    last = rank == k - 1
    floor = floor.copy()
    floor[query[last]] = np.maximum(floor[query[last]], _within(score[last].astype(np.float64)))
    kept = rank < k
    return [query[kept], ids[kept], score[kept]], floor


def _matrix(vectors: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), width).astype(np.int64, copy=False)


def _search(k: int):
    """The function over a shard's rows, candidates first."""
    names = ["query_uid", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, lists = None, {}, {}
        for batch in batches:
            shards, is_query, uids, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vectors = batch.column(4)
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            borders = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])[: len(shards)])
            for begin, end in zip(borders, np.append(borders[1:], len(shards))):
                if shards[begin] != shard:
                    shard, held, lists = shards[begin], {}, {}
                rows = np.arange(begin, end)
                for width in np.unique(widths[rows]).tolist():
                    same = rows[widths[rows] == width]
                    new = same[~is_query[same]]
                    if len(new):
                        held.setdefault(width, []).append((ids[new], uids[new], _matrix(vectors, new, width)))
                    asked = same[is_query[same]]
                    # All candidates of the shard come before its first query.
                    if len(asked) and width in held:
                        lists[width] = Lists(*map(np.concatenate, zip(*held.pop(width))))
                    for at in range(0, len(asked) if width in lists else 0, BATCH_QUERIES):
                        part = asked[at : at + BATCH_QUERIES]
                        q, found, score = lists[width].best(_matrix(vectors, part, width), uids[part], k)
                        columns = [uids[part][q], ids[part][q], found, score]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``(vec_id, embedding)`` for which ``is_query`` holds, the best others."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        whole.alias("vector"),
    )
    n = vectors.count()
    parallel = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(buckets(n, SHARD_ROWS), min(parallel, buckets(n, LEAST_ROWS)))
    own = F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    places = F.array(F.struct(own.alias("shard"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("asks")))
    dealt = rows.select(F.explode(F.when(F.col("asks"), F.concat(places, asked)).otherwise(places)).alias("_p"), "uid", "vec_id", "vector")
    dealt = dealt.select("_p.shard", "_p.asks", "uid", "vec_id", "vector").repartitionById(count, "shard")
    best = dealt.sortWithinPartitions("shard", "asks").mapInArrow(_search(k), "query_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
