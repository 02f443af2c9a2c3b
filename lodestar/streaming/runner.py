"""Starting streams whose batches are handled by a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

OnBatch = Callable[[DataFrame, int], None]


def start(
    stream: DataFrame,
    on_batch: OnBatch,
    checkpoint: str,
    output_mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start ``stream``; a live one with a batch each ``every`` (such as ``"10 milliseconds"``),
    without it all that is available now and then stop.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(on_batch)
        .trigger(**trigger)
        .start()
    )


def replay(
    stream: DataFrame, on_batch: OnBatch, checkpoint: str, output_mode: str = "append"
) -> None:
    """Run all that is available now to its end."""
    query = start(stream, on_batch, checkpoint, output_mode)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def run_until(query: StreamingQuery, done: Callable[[], bool], poll: float = 0.05) -> None:
    """Wait for a live query until ``done()`` and stop it; it may also end by itself, and its errors are raised.

    ``done`` is asked between batches and inside them, so it should tell what is finished. The batch at work when
    the query is stopped is given up; it would run again if the query were started again.
    """
    try:
        while not query.awaitTermination(poll):
            if done():
                break
    finally:
        query.stop()
