"""Word counts over documents (lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions import check_at_least, tokens


def words(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(word)``, one row for each word of each line."""
    return lines.select(F.explode(tokens(F.col(line))).alias("word"))


def doc_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_docs"))


def word_count(lines: DataFrame) -> DataFrame:
    """One round: the partial aggregate combines before the single shuffle on ``word``."""
    return words(lines).groupBy("word").agg(F.count("*").alias("n"))


def word_count_salted(lines: DataFrame, salts: int = 8, seed: int = 42, salt: str = "map") -> DataFrame:
    """Two rounds: counts by (random salt, word), then by word.

    ``salt="map"`` draws the salt with each word, ``salt="group"`` draws it in
    the grouping key. The result is that of :func:`word_count`; the first round
    spreads each word over ``salts`` tasks. The draw is a hash of seed, line,
    place in the line and all other columns of ``lines``, which should tell equal
    lines apart (``lines_from(..., keep=["doc_id"])``): a task that runs again
    after a failure draws the same.
    """
    check_at_least(1, salts=salts)
    first = salted_words(lines, salts, seed, salt)
    return (
        first.agg(F.count("*").alias("part"))
        .groupBy("word")
        .agg(F.sum("part").alias("n"))
    )


def salted_words(lines: DataFrame, salts: int, seed: int, salt: str) -> GroupedData:
    """The words grouped by salt and word."""
    drawn = F.pmod(F.xxhash64("row_hash", "place", "word"), F.lit(salts)).alias("salt")
    each = lines.select(
        F.xxhash64(F.lit(seed), *lines.columns).alias("row_hash"),
        F.posexplode(tokens(F.col("line"))).alias("place", "word"),
    )
    if salt == "map":
        return each.select("word", drawn).groupBy("salt", "word")
    if salt == "group":
        return each.groupBy(drawn, "word")
    raise ValueError(f"salt must be 'map' or 'group', got {salt!r}")


def word_count_by_partition(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Two rounds: counts by (partition, word), then by word.

    ``partitions`` first spreads the lines at random; without it the partitions of the scan are
    used. A word is spread over as many groups as partitions hold it. The number of a partition is
    only a salt: a scan that is split otherwise gives the same result.
    """
    if partitions is not None:
        check_at_least(1, partitions=partitions)
        lines = lines.repartition(partitions)
    return (
        words(lines)
        .withColumn("partition", F.spark_partition_id())
        .groupBy("partition", "word")
        .agg(F.count("*").alias("part"))
        .groupBy("word")
        .agg(F.sum("part").alias("n"))
    )


def distinct_words(counts: DataFrame) -> DataFrame:
    """Vocabulary size from word counts."""
    return counts.agg(F.count("*").alias("n_words"))


def avg_word_length(counts: DataFrame) -> DataFrame:
    """Integer mean length of the distinct words; NULL without words."""
    return counts.agg(F.expr("sum(length(word)) div count(*)").alias("avg_length"))
