"""DuckDB SQL with the results of the registered queries, written from the definitions."""

from __future__ import annotations

from . import queries as q
from .functions import cell_side, sample_size, sticky_rate

# Bins unrolled for the sticky table: enough for streams of r * 2^16 items; longer ones are an error.
SQL_BINS = 15

LINES = r"""lines AS (
  SELECT unnest(regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')) AS line
  FROM documents WHERE text <> '')"""

WORDS = f"""{LINES}, words AS (
  SELECT unnest(CASE WHEN line <> '' AND rtrim(line, ' ') = '' THEN CAST([] AS VARCHAR[])
                     ELSE string_split(rtrim(line, ' '), ' ') END) AS word
  FROM lines), counts AS (SELECT word, count(*) AS n FROM words GROUP BY word)"""

POINTS = """points AS (
  SELECT event_id AS id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x,
         CAST(CAST(user_id AS FLOAT) AS DOUBLE) AS y FROM events)"""

ITEMS = """items AS (SELECT event_id AS t, CAST(floor(value) AS BIGINT) AS item FROM events)"""


def _double(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _cells(side: str = _double(cell_side(q.DISTANCE)), points: str = POINTS) -> str:
    return f"""{points}, cells AS (
  SELECT CAST(floor(x / {side}) AS BIGINT) AS i, CAST(floor(y / {side}) AS BIGINT) AS j,
         count(*) AS size
  FROM points GROUP BY 1, 2), hood AS (
  SELECT c.i, c.j, c.size,
         CAST(sum(CASE WHEN abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1 THEN o.size ELSE 0 END)
              AS BIGINT) AS n3,
         CAST(sum(o.size) AS BIGINT) AS n7
  FROM cells c JOIN cells o ON o.i BETWEEN c.i - 3 AND c.i + 3 AND o.j BETWEEN c.j - 3 AND c.j + 3
  GROUP BY c.i, c.j, c.size), classes AS (
  SELECT *, CASE WHEN n7 <= {q.M} THEN 'sure' WHEN n3 <= {q.M} THEN 'uncertain'
                 ELSE 'non_outlier' END AS class
  FROM hood)"""


SUMMARY = """CAST(coalesce(sum(size) FILTER (class = 'sure'), 0) AS BIGINT) AS sure_outliers,
  CAST(coalesce(sum(size) FILTER (class = 'uncertain'), 0) AS BIGINT) AS uncertain_points"""


def _balls(distance: float) -> str:
    return f"""{POINTS}, balls AS (
  SELECT a.id, a.x, a.y, count(*) AS ball
  FROM points a JOIN points b
    ON b.x BETWEEN a.x - {distance + 1} AND a.x + {distance + 1}
   AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= {_double(distance * distance)}
  GROUP BY a.id, a.x, a.y), outliers AS (SELECT * FROM balls WHERE ball <= {q.M})"""


BALLS = _balls(q.DISTANCE)


def _traversal(source: str, name: str, k: int) -> str:
    """Farthest-first traversal of each part of ``source``, one step for each center."""
    steps = [f"{name}1 AS (SELECT part, 0 AS ord, id, x, y FROM {source} "
             "QUALIFY row_number() OVER (PARTITION BY part ORDER BY id) = 1)"]
    for step in range(1, k):
        steps.append(f"""{name}{step + 1} AS (
  SELECT * FROM {name}{step} UNION ALL
  SELECT part, {step} AS ord, id, x, y FROM (
    SELECT p.part, p.id, p.x, p.y,
           min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d2
    FROM {source} p JOIN {name}{step} c ON p.part = c.part GROUP BY p.part, p.id, p.x, p.y)
  WHERE d2 > 0
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY d2 DESC, id) = 1)""")
    return ", ".join(steps)


CORESET = f"""{POINTS}, parted AS (
  SELECT id % {q.PARTS} AS part, id, x, y FROM points), {_traversal("parted", "s", q.CENTERS)}"""
CHOSEN = f"""{CORESET}, coreset AS (SELECT 0 AS part, id, x, y FROM s{q.CENTERS}),
{_traversal("coreset", "c", q.CENTERS)}, centers AS (SELECT ord, id, x, y FROM c{q.CENTERS})"""
NEAREST = f"""{CHOSEN}, assigned AS (
  SELECT p.id, c.ord AS center,
         (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS d2
  FROM points p, centers c
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d2, c.ord) = 1),
radius AS (SELECT sqrt(max(d2)) AS radius FROM assigned)"""

CAPPED = f"""{ITEMS.replace("items AS", "all_items AS", 1)}, items AS (SELECT t, item FROM all_items WHERE t < {q.CAP})"""
PREFIX = f"""{ITEMS.replace("items AS", "all_items AS", 1)}, items AS (
  SELECT t, item FROM all_items WHERE t < (SELECT coalesce(max(t), 0) + 1 FROM all_items) * {q.BATCH_ENDS[q.PREFIX - 1]} // 100)"""
BATCHES = f"""{ITEMS}, total AS (SELECT coalesce(max(t), 0) + 1 AS n FROM items),
ends AS (SELECT unnest([{", ".join(f"n * {end} // 100" for end in q.BATCH_ENDS)}]) AS stop,
                unnest(range({len(q.BATCH_ENDS)})) AS batch_id FROM total),
batched AS (
  SELECT t, item, (SELECT min(batch_id) FROM ends WHERE t < stop) AS batch_id FROM items),
sizes AS (SELECT batch_id, count(*) AS n, min(t) AS first FROM batched GROUP BY batch_id)"""


def _word60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"



def _marked(estimates: str, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN item IN (SELECT item FROM true_items) THEN '+'
  ELSE '-' END AS mark FROM {estimates}"""


def _binned(phi: float, epsilon: float, delta: float = q.DELTA) -> str:
    rate = sticky_rate(phi, epsilon, delta)
    bounds = " + ".join(
        f"CAST(t >= {_double(2 * rate * 2.0**k)} AS INT)" for k in range(SQL_BINS + 1)
    )
    return f"binned AS (SELECT t, item, {bounds} AS bin FROM items)"


def _sticky(phi: float, epsilon: float, delta: float = q.DELTA) -> str:
    """The sticky table by one step for each bin."""
    steps = [f"""{_binned(phi, epsilon, delta)},
coins AS (
  SELECT *, bin = 0 OR ({_word60(f"'{q.SEED}:coin:' || item || ':' || t")} >> (60 - bin)) = 0 AS win
  FROM binned),
followed AS (
  SELECT *, bool_or(win) OVER (PARTITION BY item, bin ORDER BY t ROWS UNBOUNDED PRECEDING) AS won
  FROM coins),
seen AS (
  SELECT item, bin, count(*) AS n, count(*) FILTER (won) AS a FROM followed GROUP BY item, bin),
last_bin AS (
  SELECT CASE WHEN max(bin) > {SQL_BINS} THEN CAST(error('more bins than steps') AS INT) ELSE max(bin) END AS b
  FROM binned),
e0 AS (SELECT item, coalesce(max(a) FILTER (bin = 0), 0) AS e FROM seen GROUP BY item)"""]
    for k in range(1, SQL_BINS + 1):
        word = _word60(f"'{q.SEED}:tau:' || item || ':{k}'")
        lost = "CASE WHEN h = 0 THEN 60 ELSE 60 - length(bin(h)) END"
        steps.append(f"""d{k} AS (
  SELECT item, CASE WHEN {k} > (SELECT b FROM last_bin) THEN e
                    ELSE greatest(0, e - {lost}) END AS e
  FROM (SELECT item, e, {word} AS h FROM e{k - 1})),
e{k} AS (
  SELECT d.item, CASE WHEN d.e > 0 THEN d.e + coalesce(g.n, 0) ELSE coalesce(g.a, 0) END AS e
  FROM d{k} d LEFT JOIN seen g ON g.item = d.item AND g.bin = {k})""")
    steps.append(
        f"sticky AS (SELECT item, CAST(e AS BIGINT) AS est FROM e{SQL_BINS} WHERE e > 0)"
    )
    return ", ".join(steps)


def _freq(phi: float, items: str = ITEMS) -> str:
    return f"""{items}, freqs AS (SELECT item, count(*) AS freq FROM items GROUP BY item),
true_items AS (SELECT item, freq FROM freqs
  WHERE freq >= {_double(phi)} * (SELECT count(*) FROM items))"""


def _reservoir(phi: float) -> str:
    return f"""sample AS (
  SELECT {_word60(f"'{q.SEED}:res:' || t")} AS key, t, item FROM items
  ORDER BY key, substr(md5('{q.SEED}:res:' || t), 16, 17), t LIMIT {sample_size(phi)})"""


def _reported(phi: float, epsilon: float) -> str:
    return f"""reported AS (SELECT item, est FROM sticky
  WHERE est >= {_double(phi - epsilon)} * (SELECT count(*) FROM items))"""


def _report(phi: float, epsilon: float, delta: float) -> str:
    return f"""WITH {_freq(phi)}, {_reservoir(phi)}, {_sticky(phi, epsilon, delta)}, {_reported(phi, epsilon)},
from_sample AS ({_marked("(SELECT DISTINCT item FROM sample)", "item")}),
from_table AS ({_marked("reported", "item")})
SELECT 'n_processed' AS metric, count(*) AS value FROM items
UNION ALL SELECT 'table_size', count(*) FROM freqs
UNION ALL SELECT 'n_true', count(*) FROM true_items
UNION ALL SELECT 'reservoir_m', {sample_size(phi)}
UNION ALL SELECT 'reservoir_reported', count(*) FROM from_sample
UNION ALL SELECT 'reservoir_right', count(*) FILTER (mark = '+') FROM from_sample
UNION ALL SELECT 'reservoir_wrong', count(*) FILTER (mark = '-') FROM from_sample
UNION ALL SELECT 'sticky_size', count(*) FROM sticky
UNION ALL SELECT 'sticky_reported', count(*) FROM from_table
UNION ALL SELECT 'sticky_right', count(*) FILTER (mark = '+') FROM from_table
UNION ALL SELECT 'sticky_wrong', count(*) FILTER (mark = '-') FROM from_table"""


FREQ = _freq(q.PHI)
RESERVOIR = _reservoir(q.PHI)
STICKY = _sticky(q.PHI, q.EPSILON)
REPORTED = _reported(q.PHI, q.EPSILON)
REPORT = _report(q.PHI, q.EPSILON, q.DELTA)

LARGEST = "greatest(coalesce(max(item), 0), 0)"
WORD_COUNT = f"WITH {WORDS} SELECT word, n FROM counts"
ITEM_FREQ = f"WITH {FREQ} SELECT item, freq FROM freqs"
DISTINCT = f"WITH {ITEMS} SELECT DISTINCT item FROM items"
TRUE_FREQUENT = f"WITH {FREQ} SELECT item, freq FROM true_items"
SAMPLE = f"WITH {ITEMS}, {RESERVOIR} SELECT key, t, item FROM sample"
SAMPLE_MARKED = (
    f"WITH {FREQ}, {RESERVOIR} " + _marked("(SELECT DISTINCT item FROM sample)", "item")
)
STICKY_TABLE = f"WITH {ITEMS}, {STICKY} SELECT item, est FROM sticky"
STICKY_MARKED = f"WITH {FREQ}, {STICKY}, {REPORTED} " + _marked("reported", "item, est")
RADIUS_CELLS = _cells("(SELECT radius / (2 * sqrt(CAST(2 AS DOUBLE))) FROM radius)", NEAREST)

ORACLE_SQL: dict[str, str] = {
    "doc_count": f"WITH {LINES} SELECT count(*) AS n_docs FROM lines",
    "word_count": WORD_COUNT,
    "word_count_salted": WORD_COUNT,
    "word_count_salted_inline": WORD_COUNT,
    "word_count_by_partition": WORD_COUNT,
    "distinct_words": f"WITH {WORDS} SELECT count(*) AS n_words FROM counts",
    "avg_word_length": f"WITH {WORDS} "
    "SELECT CAST(sum(length(word)) // count(*) AS BIGINT) AS avg_length FROM counts",
    "point_count": f"WITH {POINTS} SELECT count(*) AS n_points FROM points",
    "cell_sizes": f"WITH {_cells()} SELECT i, j, size FROM cells",
    "cell_neighbourhood": f"WITH {_cells()} SELECT i, j, size, n3, n7 FROM hood",
    "cell_classes": f"WITH {_cells()} SELECT i, j, size, n3, n7, class FROM classes",
    "outlier_summary": f"WITH {_cells()} SELECT {SUMMARY} FROM classes",
    "outlier_summary_wide": f"WITH {_cells(_double(cell_side(q.WIDE)))} SELECT {SUMMARY} FROM classes",
    "smallest_cells": f"WITH {_cells()} SELECT i, j, size FROM cells "
    f"ORDER BY size, i, j LIMIT {q.TOP}",
    "ball_counts": f"WITH {BALLS} SELECT id, ball FROM balls",
    "exact_outliers": f"WITH {BALLS} SELECT id, x, y, ball FROM outliers",
    "exact_outlier_count": f"WITH {BALLS} SELECT count(*) AS n_outliers FROM outliers",
    "exact_outlier_count_wide": f"WITH {_balls(q.WIDE)} "
    "SELECT count(*) AS n_outliers FROM outliers",
    "top_outliers": f"WITH {BALLS} SELECT DISTINCT x, y, ball FROM outliers "
    f"ORDER BY ball, x, y LIMIT {q.TOP}",
    "kcenter_coreset": f"WITH {CORESET} SELECT part, ord, id, x, y FROM s{q.CENTERS}",
    "kcenter_centers": f"WITH {CHOSEN} SELECT ord, id, x, y FROM centers",
    "kcenter_assignment": f"WITH {NEAREST} SELECT id, center, d2 FROM assigned",
    "kcenter_radius": f"WITH {NEAREST} SELECT radius FROM radius",
    "kcenter_outliers": f"WITH {RADIUS_CELLS} "
    f"SELECT (SELECT radius FROM radius) AS radius, {SUMMARY} FROM classes",
    "item_positions": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS t "
    "FROM events",
    "stream_bins": f"WITH {ITEMS}, {_binned(q.PHI, q.EPSILON)} "
    "SELECT bin, count(*) AS n FROM binned GROUP BY bin",
    "item_freq": ITEM_FREQ,
    "distinct_items": DISTINCT,
    "distinct_item_count": f"WITH {ITEMS} SELECT count(DISTINCT item) AS n_distinct FROM items",
    "largest_item": f"WITH {ITEMS} SELECT {LARGEST} AS largest FROM items",
    "true_frequent": TRUE_FREQUENT,
    "reservoir_sample": SAMPLE,
    "reservoir_marked": SAMPLE_MARKED,
    "sticky_table": STICKY_TABLE,
    "sticky_table_fine": f"WITH {ITEMS}, {_sticky(q.FINE_PHI, q.FINE_EPSILON)} "
    "SELECT item, est FROM sticky",
    "sticky_marked": STICKY_MARKED,
    "frequent_summary": REPORT,
    "frequent_summary_published": _report(*q.PUBLISHED),
    "reservoir_sample_capped": f"WITH {CAPPED}, {RESERVOIR} SELECT key, t, item FROM sample",
    "sticky_table_capped": f"WITH {CAPPED}, {STICKY} SELECT item, est FROM sticky",
    "file_points": f"WITH {POINTS} SELECT id, x, y FROM points",
    "file_items": f"WITH {ITEMS} SELECT t, item FROM items",
    "file_word_count": "WITH words AS (SELECT unnest([event_type, 'of', event_type]) AS word FROM events) "
    "SELECT word, count(*) AS n FROM words GROUP BY word",
    "batch_sizes": f"WITH {BATCHES} SELECT batch_id, n FROM sizes",
    "batch_times": f"WITH {BATCHES} SELECT batch_id, n, TRUE AS later FROM sizes",
    "stream_distinct_summary": f"WITH {ITEMS} SELECT 'n_distinct' AS metric, count(DISTINCT item) AS value FROM items "
    f"UNION ALL SELECT 'largest', {LARGEST} FROM items",
    "stream_state_counts": ITEM_FREQ,
    "stream_state_counts_capped": f"WITH {CAPPED} SELECT item, count(*) AS freq FROM items GROUP BY item",
    "stream_sticky_prefix": f"WITH {PREFIX}, {STICKY} SELECT item, est FROM sticky",
    "stream_live_item_freq": f"WITH {CAPPED} SELECT item, count(*) AS freq FROM items GROUP BY item",
    "stream_live_reservoir": f"WITH {CAPPED}, {RESERVOIR} SELECT key, t, item FROM sample",
    "stream_summary_stopped": f"WITH {BATCHES}, taken AS (SELECT b.* FROM batched b JOIN sizes s USING (batch_id) "
    f"WHERE s.first < {q.THRESHOLD}) SELECT 'n_processed' AS metric, count(*) AS value FROM taken "
    "UNION ALL SELECT 'n_distinct', count(DISTINCT item) FROM taken "
    f"UNION ALL SELECT 'largest', {LARGEST} FROM taken",
    "stream_reservoir_capped": f"WITH {CAPPED}, {RESERVOIR} SELECT key, t, item FROM sample",
    "stream_sticky_capped": f"WITH {CAPPED}, {STICKY} SELECT item, est FROM sticky",
    "stream_summary": f"WITH {ITEMS} SELECT 'n_processed' AS metric, count(*) AS value FROM items "
    "UNION ALL SELECT 'n_distinct', count(DISTINCT item) FROM items "
    f"UNION ALL SELECT 'largest', {LARGEST} FROM items",
    "stream_item_freq": ITEM_FREQ,
    "stream_distinct_items": DISTINCT,
    "stream_true_frequent": TRUE_FREQUENT,
    "stream_reservoir": SAMPLE,
    "stream_sticky_table": STICKY_TABLE,
    "stream_reservoir_marked": SAMPLE_MARKED,
    "stream_sticky_marked": STICKY_MARKED,
    "stream_frequent_summary": REPORT,
}
