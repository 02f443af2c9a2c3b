"""Document fingerprints from spot signatures.

A signature starts at an anchor, a common word, and chains it with the content
words that follow. In a run of words without any common word, words from a
certain distance on are anchors themselves, so that texts in other languages,
lists and junk have signatures too; where a word stands in a text does not
matter, so a local edit only changes the signatures near it. The multiset of a
text's signature hashes is its fingerprint, the Jaccard similarity of two of
them their likeness.

Near duplicates (``near_classes``, which no query uses) are found by the exact
join of ``jaccard`` over the signature sets, not by SpotSigs' partitions of set
lengths; ``likeness`` can prune by length, and its callers here do not ask it to.

Defined cases: a null text counts as empty; a text without words has the empty
fingerprint, and two empty fingerprints are alike by 1, an empty and another
one by 0; short texts have their words as signatures besides, as do longer ones in
which no chain is found (only common words); ties of the order of
documents (equal ids) go by text; documents without an id come first; a single
document follows itself; repeated rows are fingerprinted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import TASK_CHARS, buckets, table
from .jaccard import WordHashes, classes, mix

#: Content words chained to an anchor.
CHAIN = 2
#: Words without an anchor after which each word is one.
DESERT = 8
#: Below so many words, each word is a signature besides.
SHORT = 24
#: Ranges of ids at most; larger ones only make longer tasks, which stream their rows.
MAX_RANGES = 40_000
BATCH_BYTES = 4 << 20

# Common words of English, German, French and Spanish, with one space around each.
COMMON = frozenset(
    (
        "the a an of and to in is it that this for on with as are was be by at from or not have has but they you we he she his her its "
        "der die das den dem des ein eine einer eines und ist nicht mit von zu im in auf für sich auch als an es er sie wir war "
        "le la les un une des du de et est que qui dans pour par sur pas au aux avec ce il elle nous vous en ne se "
        "el los las una unos y es no por con para su sus del al lo como más o pero fue"
    ).encode().split()
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


class _Words(WordHashes):
    """Hashes of words without the punctuation around them; the lowest bit tells a common word."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGES)
        if len(self) > 300_000:
            self.clear()
        # Hashed apart from the memo: what is stored must not depend on the words read before.
        value = self[word] = (xxhash.xxh3_64_intdigest(core or word) & ~1) | (core in COMMON)
        return value


def spots(text: str, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the (numbered) spot signatures of a whole text."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    count = len(words)
    if not count:
        return np.zeros(0, dtype=np.uint32)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=count)
    common = (hashes & np.uint64(1)).astype(bool)
    index = np.arange(count)
    since = index - np.maximum.accumulate(np.where(common, index, -1))
    anchors = np.flatnonzero(common | (since >= DESERT))
    content = np.flatnonzero(~common)
    first = np.searchsorted(content, anchors, side="right")
    whole = first + CHAIN <= len(content)
    anchors, first = anchors[whole], first[whole]
    signature = mix(hashes[anchors])
    for k in range(CHAIN):
        signature = mix(signature + hashes[content[first + k]])
    if count < SHORT or not len(signature):
        signature = np.concatenate([signature, mix(hashes ^ np.uint64(CHAIN))])
    # A signature that repeats counts as often: its occurrences are numbered.
    signature = np.sort(signature)
    place = np.arange(len(signature))
    start = np.maximum.accumulate(np.where(np.append(True, signature[1:] != signature[:-1]), place, 0))
    return np.unique((mix(signature + (place - start).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, ascending."""
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at them where their lengths keep it below ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return 0.0
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _bucket(cuts: list[int]) -> Column:
    """Number of the cuts below the id, found in two steps of about the root of their count."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    below = lambda cut: cut < F.col("doc_id")
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::step]]), below)) - 1
    inside = F.size(F.filter(F.slice(F.array(*[F.lit(c) for c in cuts]), F.greatest(block, F.lit(0)) * step + 1, step), below))
    return F.when(F.col("doc_id").isNull() | (block < 0), F.lit(0)).otherwise(block * step + inside)


def in_order(docs: DataFrame) -> DataFrame:
    """Documents in ranges of ids, each range followed by a copy of the document that comes after its last one.

    ``(bucket, tail, doc_id, text)``, sorted inside the partitions; texts are moved once.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    totals = base.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = min(MAX_RANGES, buckets(totals["chars"] or 0, TASK_CHARS, parallel))
    shares = [k / count for k in range(1, count)]
    # Percentiles of the ids need not be exact: they only make the ranges even.
    cuts = base.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * count))).first()[0] if shares and totals["n"] else None
    placed = base.withColumn("bucket", _bucket(sorted(set(cuts or []))))
    ranges = placed.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed")).collect()
    ranges = [(r["bucket"], None if r["unnamed"] else r["least"]) for r in sorted(ranges, key=lambda r: r["bucket"])]
    # The first document of a range goes to the range before, that of the first one to the last.
    schema = "bucket int, least bigint, target int"
    heads = [(b, least, ranges[k - 1][0]) for k, (b, least) in enumerate(ranges)]
    heads = docs.sparkSession.createDataFrame(heads, schema).withColumnRenamed("bucket", "_bucket")
    same = (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("least"))
    tails = placed.join(F.broadcast(heads), same).groupBy("target", "doc_id").agg(F.min("text").alias("text"))
    rows = placed.select("bucket", F.lit(False).alias("tail"), "doc_id", "text").unionByName(
        tails.select(F.col("target").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "text")
    )
    return rows.repartition(count, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


def compare_with_following(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents ``(doc_id, text)`` and of their edited texts, and their likeness.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    schema = StructType.fromDDL(
        "doc_id bigint, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        out: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for tail, doc_id, text in zip(batch.column(1), batch.column(2), batch.column(3)):
                doc_id, text = doc_id.as_py(), text.as_py()
                found = spots(text, memo)
                if last is not None:
                    own_id, own_text, own = last
                    new_text = edited(own_text, text)
                    new = spots(new_text, memo)
                    digest = hashlib.sha256(new_text.encode("utf-8", "replace")).hexdigest()
                    out.append((own_id, len(own_text), digest, fingerprint(own), fingerprint(new), likeness(own, new), likeness(own, found)))
                    size += 8 * (len(own) + len(new)) + 200
                last = None if tail.as_py() else (doc_id, text, found)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return in_order(docs).mapInArrow(run, schema)


def _signature_maker():
    memo = _Words()
    return lambda texts: [np.sort(mix(spots(t or "", memo).astype(np.uint64))) for t in texts]


def near_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_signatures, component_id)``: documents joined where their signatures agree to 80 percent or more."""
    return classes(docs, _signature_maker).withColumnRenamed("n_shingles", "n_signatures")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_following(table(spark, sf_dir, "documents"))
