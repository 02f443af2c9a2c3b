"""The operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from .operators import frequent, grid, kcenter, outliers, report, reservoir, sticky, words
from .plans import fresh_dir, spread, with_position
from .sources import items_from, lines_from, points_from, read_items, read_lines, read_points
from .streaming import StickyAudit
from .streaming import distinct as sizes
from .streaming import frequent as streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the oracle SQL uses the same.
DISTANCE = 4.0
WIDE = 8.0
M = 3
TOP = 20
CENTERS = 4
PARTS = 3
PHI = 0.02
EPSILON = 0.01
DELTA = 0.1
FINE_PHI = 0.01
FINE_EPSILON = 0.005
SEED = 42
SALTS = 16
# Replayed streams: the shares of the events after which a batch ends, in percent.
BATCH_ENDS = (10, 45, 46, 70, 100)
# Batches of which the sticky table is recomputed.
PREFIX = 3
CAP = 9_000
THRESHOLD = 4_000
# The parameters of the published runs.
PUBLISHED = (0.07, 0.03, 0.1)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    return lines_from(spread(documents), "text")


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return lines_from(spread(documents), "text", keep=["doc_id"])


def _as_text(spark: SparkSession, df: DataFrame, order: str, *columns: Column) -> str:
    """A folder of text files with a line for each row, in order."""
    path = fresh_dir(spark, "lines")
    line = F.concat_ws(",", *[c.cast("string") for c in columns]).alias("line")
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)
    ordered.select(line).write.text(path)
    return path


def _point_file(spark: SparkSession, sf: str) -> str:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "user_id")
    return _as_text(spark, events, "event_id", F.col("value"), F.col("user_id"))


def _item_file(spark: SparkSession, sf: str) -> str:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return _as_text(spark, events, "event_id", F.floor("value"))


def _line_file(spark: SparkSession, sf: str) -> str:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    return _as_text(spark, events, "event_id", F.concat_ws(" ", "event_type", F.lit("of"), "event_type"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return points_from(events, "value", "user_id", "event_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return items_from(events, F.floor("value"), t="event_id")


def _replay(spark: SparkSession, sf: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Feed all events to a stream in uneven batches: each run of the query takes what has been added since."""
    path = fresh_dir(spark, "events")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    low = 0
    for end in BATCH_ENDS:
        high = n * end // 100
        part = events.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        start(items_from(stream, F.floor("value"), t="event_id")).awaitTermination()
        low = high


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return words.word_count(_lines(spark, sf))


def _centers(spark: SparkSession, sf: str) -> DataFrame:
    return kcenter.kcenter_centers(_points(spark, sf), CENTERS, PARTS)


def _item_positions(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id")
    return with_position(events, ["ts", "event_id"], "t").select("event_id", "t")


def _frequent_stream(
    spark: SparkSession, sf: str, *keep: str, n: int | None = None
) -> streams.FrequentStream:
    stream = streams.FrequentStream(
        fresh_dir(spark, "stream"), PHI, EPSILON, DELTA, n=n, seed=SEED, keep=keep
    )
    _replay(spark, sf, stream.start)
    return stream


def _stream_freq(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "freq")
    _replay(spark, sf, lambda items: streams.run_item_freq(items, path))
    return streams.stream_item_freq(spark, path)


def _stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "distinct")
    _replay(spark, sf, lambda items: sizes.run_distinct(items, path))
    return sizes.distinct_rows(spark, path)


def _sized(spark: SparkSession, sf: str, threshold: int | None = None) -> str:
    path = fresh_dir(spark, "sizes")
    _replay(spark, sf, sizes.SizedStream(path, threshold).start)
    return path


def _batch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sizes.batch_sizes(spark, _sized(spark, sf)).select("batch_id", "n")


def _batch_times(spark: SparkSession, sf: str) -> DataFrame:
    """Batch sizes, and whether the batch began after the one before."""
    found = sizes.batch_sizes(spark, _sized(spark, sf))
    before = F.lag("at").over(Window.orderBy("batch_id"))
    return found.select("batch_id", "n", F.coalesce(F.col("at") > before, F.col("at").isNotNull()).alias("later"))


def _distinct_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "summary")
    _replay(spark, sf, lambda items: sizes.run_distinct_summary(items, path))
    return sizes.distinct_summary(spark, path)


def _event_files(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """A stream of all events, in order, that takes up a file in each batch, and their number."""
    path = fresh_dir(spark, "events")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    events.repartitionByRange(len(BATCH_ENDS), "event_id").write.parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return items_from(source, F.floor("value"), t="event_id"), events.count()


def _state_counts(spark: SparkSession, sf: str, n: int | None = None) -> DataFrame:
    path = fresh_dir(spark, "counts")
    items, _ = _event_files(spark, sf)
    with streams.rocksdb_state(spark):
        query = streams.run_item_counts(items, path, n)
    query.awaitTermination()
    return streams.item_counts(spark, path)


def _sticky_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The sticky table after three of five batches, recomputed when the stream has ended."""
    audit = StickyAudit(fresh_dir(spark, "audit"), PHI, EPSILON, DELTA, seed=SEED)
    _replay(spark, sf, audit.start)
    return audit.table(spark, PREFIX - 1)


def _live_stream(spark: SparkSession, sf: str, *keep: str) -> streams.FrequentStream:
    """A live query over all events; it ends by itself inside the batch that holds the last one wanted."""
    items, total = _event_files(spark, sf)
    # A live query for more than there will ever be would wait for ever.
    n = min(CAP, total)
    stream = streams.FrequentStream(
        fresh_dir(spark, "stream"), PHI, EPSILON, DELTA, n=n or None, seed=SEED, keep=keep
    )
    if n:
        stream.run(items, every="50 milliseconds")
    return stream


QUERIES: dict[str, Query] = {
    # Documents
    "doc_count": lambda s, d: words.doc_count(_lines(s, d)),
    "word_count": lambda s, d: words.word_count(_lines(s, d)),
    "word_count_salted": lambda s, d: words.word_count_salted(_document_lines(s, d), SALTS, SEED),
    "word_count_salted_inline": lambda s, d: words.word_count_salted(
        _document_lines(s, d), SALTS, SEED, salt="group"
    ),
    "word_count_by_partition": lambda s, d: words.word_count_by_partition(_lines(s, d)),
    "distinct_words": lambda s, d: words.distinct_words(_counts(s, d)),
    "avg_word_length": lambda s, d: words.avg_word_length(_counts(s, d)),
    # Points
    "point_count": lambda s, d: outliers.point_count(_points(s, d)),
    "cell_sizes": lambda s, d: grid.cell_sizes(_points(s, d), DISTANCE),
    "cell_neighbourhood": lambda s, d: grid.cell_neighbourhood(_points(s, d), DISTANCE),
    "cell_classes": lambda s, d: grid.cell_classes(_points(s, d), DISTANCE, M),
    "outlier_summary": lambda s, d: grid.outlier_summary(_points(s, d), DISTANCE, M),
    "outlier_summary_wide": lambda s, d: grid.outlier_summary(_points(s, d), WIDE, M),
    "smallest_cells": lambda s, d: grid.smallest_cells(_points(s, d), DISTANCE, TOP),
    "ball_counts": lambda s, d: outliers.ball_counts(_points(s, d), DISTANCE),
    "exact_outliers": lambda s, d: outliers.exact_outliers(_points(s, d), DISTANCE, M),
    "exact_outlier_count": lambda s, d: outliers.exact_outlier_count(_points(s, d), DISTANCE, M),
    "exact_outlier_count_wide": lambda s, d: outliers.exact_outlier_count(_points(s, d), WIDE, M),
    "top_outliers": lambda s, d: outliers.top_outliers(_points(s, d), DISTANCE, M, TOP),
    # k-center
    "kcenter_coreset": lambda s, d: kcenter.kcenter_coreset(_points(s, d), CENTERS, PARTS),
    "kcenter_centers": _centers,
    "kcenter_assignment": lambda s, d: kcenter.kcenter_assignment(
        _points(s, d), _centers(s, d), CENTERS
    ),
    "kcenter_radius": lambda s, d: kcenter.kcenter_radius(_points(s, d), CENTERS, PARTS),
    "kcenter_outliers": lambda s, d: kcenter.kcenter_outliers(_points(s, d), CENTERS, PARTS, M),
    # Items
    "item_positions": _item_positions,
    "stream_bins": lambda s, d: sticky.bin_sizes(_items(s, d), PHI, EPSILON, DELTA),
    "item_freq": lambda s, d: frequent.item_freq(_items(s, d)),
    "distinct_items": lambda s, d: frequent.distinct_items(_items(s, d)),
    "distinct_item_count": lambda s, d: frequent.distinct_item_count(_items(s, d)),
    "largest_item": lambda s, d: frequent.largest_item(_items(s, d)),
    "true_frequent": lambda s, d: frequent.true_frequent(_items(s, d), PHI),
    "reservoir_sample": lambda s, d: reservoir.reservoir_sample(_items(s, d), PHI, seed=SEED),
    "reservoir_marked": lambda s, d: reservoir.reservoir_marked(_items(s, d), PHI, seed=SEED),
    "sticky_table": lambda s, d: sticky.sticky_table(_items(s, d), PHI, EPSILON, DELTA, seed=SEED),
    "sticky_table_fine": lambda s, d: sticky.sticky_table(
        _items(s, d), FINE_PHI, FINE_EPSILON, DELTA, seed=SEED
    ),
    "sticky_marked": lambda s, d: sticky.sticky_marked(
        _items(s, d), PHI, EPSILON, DELTA, seed=SEED
    ),
    "frequent_summary": lambda s, d: report.frequent_summary(
        _items(s, d), PHI, EPSILON, DELTA, seed=SEED
    ),
    "frequent_summary_published": lambda s, d: report.frequent_summary(
        _items(s, d), *PUBLISHED, seed=SEED
    ),
    "reservoir_sample_capped": lambda s, d: reservoir.reservoir_sample(
        _items(s, d), PHI, CAP, seed=SEED
    ),
    "sticky_table_capped": lambda s, d: sticky.sticky_table(
        _items(s, d), PHI, EPSILON, DELTA, CAP, seed=SEED
    ),
    # Files
    "file_points": lambda s, d: read_points(s, _point_file(s, d)),
    "file_items": lambda s, d: read_items(s, _item_file(s, d)),
    "file_word_count": lambda s, d: words.word_count(read_lines(s, _line_file(s, d))),
    # Streams
    "batch_sizes": _batch_sizes,
    "batch_times": _batch_times,
    "stream_distinct_summary": _distinct_summary,
    "stream_state_counts": _state_counts,
    "stream_state_counts_capped": lambda s, d: _state_counts(s, d, CAP),
    "stream_sticky_prefix": _sticky_prefix,
    "stream_live_item_freq": lambda s, d: _live_stream(s, d, "exact").item_freq(s),
    "stream_live_reservoir": lambda s, d: _live_stream(s, d, "reservoir").reservoir(s),
    "stream_summary": lambda s, d: sizes.distinct_report(s, _sized(s, d)),
    "stream_summary_stopped": lambda s, d: sizes.distinct_report(s, _sized(s, d, THRESHOLD)),
    "stream_item_freq": _stream_freq,
    "stream_distinct_items": _stream_distinct,
    "stream_true_frequent": lambda s, d: _frequent_stream(s, d, "exact").true_frequent(s),
    "stream_reservoir": lambda s, d: _frequent_stream(s, d, "reservoir").reservoir(s),
    "stream_sticky_table": lambda s, d: _frequent_stream(s, d, "sticky").sticky_table(s),
    "stream_reservoir_capped": lambda s, d: _frequent_stream(s, d, "reservoir", n=CAP).reservoir(s),
    "stream_sticky_capped": lambda s, d: _frequent_stream(s, d, "sticky", n=CAP).sticky_table(s),
    "stream_reservoir_marked": lambda s, d: _frequent_stream(
        s, d, "exact", "reservoir"
    ).reservoir_marked(s),
    "stream_sticky_marked": lambda s, d: _frequent_stream(s, d, "exact", "sticky").sticky_marked(s),
    "stream_frequent_summary": lambda s, d: _frequent_stream(s, d, *streams.SUMMARIES).summary(s),
}
