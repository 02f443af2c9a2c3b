from .audit import StickyAudit
from .distinct import (
    SizedStream,
    batch_sizes,
    distinct_report,
    distinct_rows,
    distinct_summary,
    run_distinct,
    run_distinct_summary,
)
from .frequent import (
    FrequentStream,
    item_counts,
    item_freq_rows,
    rocksdb_state,
    run_item_counts,
    run_item_freq,
    stream_item_freq,
)
from .runner import replay, run_until, start

__all__ = [
    "FrequentStream",
    "SizedStream",
    "StickyAudit",
    "batch_sizes",
    "distinct_report",
    "distinct_rows",
    "distinct_summary",
    "item_counts",
    "item_freq_rows",
    "replay",
    "rocksdb_state",
    "run_distinct",
    "run_distinct_summary",
    "run_item_counts",
    "run_item_freq",
    "run_until",
    "start",
    "stream_item_freq",
]
