"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Statistics of each whole text are compared with cutoffs. Candidate cutoffs of a
statistic form a fixed grid; labelled documents of label 1 in a holdout show how
often a cutoff would reject good ones. A cutoff is valid for a stratum if the
exact binomial test rejects "it falsely rejects more than ``risk`` of the good
documents" at the level ``delta`` divided by the number of strata and rules. Per
stratum and rule the cutoffs are tested from the mildest on until one fails (a
fixed sequence needs no further correction), so that with probability 1 - delta
no valid cutoff exceeds its risk anywhere. Of the valid cutoffs that with the
best balance of rejected labels is taken, the mildest of equals; a rule whose
cutoffs reject no document of label 0 is not used.

Defined cases: a null text has no words; a text without words fails the base
rules; a null stratum is a stratum of its own; documents of a stratum without
enough good labels are judged by the base rules only; null labels and labels of
unknown documents are not used, repeated labels of an id count as their
smallest; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import stage
from .common import WHITE, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
RISK = 0.02
DELTA = 0.05
#: So many rejected documents of label 0 weigh up one of label 1.
GOOD_WEIGHT = 5
#: Strata for which cutoffs are chosen; the driver holds a few counts for each.
MAX_STRATA = 10_000

# Candidate cutoffs, mildest first: a text is rejected above the cutoff.
GRIDS = {
    "symbol_share": [x / 100 for x in (50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1)],
    "repeat_share": [x / 100 for x in (50, 45, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3)],
    "dup_line_share": [x / 100 for x in (90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10)],
    "upper_share": [x / 100 for x in (90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 12, 10)],
    "bang_share": [x / 100 for x in (50, 40, 30, 20, 15, 10, 8, 6, 5, 4, 3, 2)],
    "long_words": [float(x) for x in (40, 30, 25, 20, 18, 16, 14, 12, 11, 10)],
    "short_words": [-float(x) / 4 for x in (4, 6, 8, 10, 12, 14, 16)],
}


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words: runs without ASCII white space."""
    plain = F.translate(text, WHITE, " " * len(WHITE))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Windows are sorted by a 64-bit hash and their words; neighbours that are equal mark their starts,
    and sorted starts cover three words each, or as many as lie before the next start.
    Texts whose windows all differ are done after the count of distinct hashes.
    """

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def repeats(h: Column) -> Column:
            # Equal windows have equal hashes; different ones with equal hashes are told apart by their words.
            keyed = F.array_sort(
                F.transform(
                    h, lambda x, i: F.struct(x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
                )
            )

            def covered(k: Column) -> Column:
                same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
                marked = F.filter(k, lambda x, j: F.coalesce(same(x, F.get(k, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(k, j + 1)), F.lit(False)))
                at = F.array_sort(F.transform(marked, lambda x: x["i"]))
                return _with(
                    at,
                    lambda s: F.aggregate(
                        F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))),
                        F.lit(0).cast("long"),
                        lambda sum_, x: sum_ + x,
                    ),
                )

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_with(keyed, covered))

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_with(hashes, repeats))

    return _with(words, of)


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bang)``."""
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    base = docs.select(F.col("doc_id"), F.col(stratum).cast("string").alias("stratum"), text.alias("_t"))
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    counted = base.select(
        "doc_id",
        "stratum",
        _with(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("_w"),
        without(WHITE).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        _with(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length(text) - without("!")).cast("long").alias("n_bang"),
    )
    return counted.select(
        "doc_id", "stratum", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"), "n_upper", "n_bang",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "upper_share": F.col("n_upper") / chars,
        "bang_share": F.col("n_bang") / chars,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly summed."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k >= n:
        return 1.0
    mean = n * p
    if k > mean + 12 * math.sqrt(mean + 1) + 12:
        return 1.0
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def choose_cutoffs(
    rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule from the statistics ``rows`` and ``labels`` (doc_id, quality) of the holdout."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.join(known, "doc_id").where(~base_failed())
    def first(name: str, value: Column) -> Column:
        """The first cutoff of the grid that rejects the text; counts of it hold all that is needed."""
        passed = F.filter(F.array(*[F.lit(c) for c in GRIDS[name]]), lambda cutoff: value <= cutoff)
        return F.struct(F.lit(name).alias("rule"), F.size(passed).alias("first"))

    firsts = [first(name, value) for name, value in _values().items()]
    counts = (
        held.select("stratum", (F.col("quality") == 1).alias("good"), F.explode(F.array(*firsts)).alias("_r"))
        .groupBy("stratum", "_r.rule", "_r.first")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    found = counts.limit(MAX_STRATA * sum(len(g) + 1 for g in GRIDS.values())).collect()
    by: dict[tuple, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in found:
        by[r["stratum"], r["rule"]][r["first"]] = r["good"], r["bad"]
    strata = {s for s, _ in by}
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata: choose a coarser stratum")
    level = delta / max(1, len(strata) * len(GRIDS))
    cutoffs: dict[str | None, dict[str, float]] = {s: {} for s in strata}
    for (stratum, rule), by_first in by.items():
        total = sum(good for good, _ in by_first.values())
        rejected = gain = best = 0
        for k, cutoff in enumerate(GRIDS[rule]):
            good, bad = by_first.get(k, (0, 0))
            rejected += good
            gain += bad - GOOD_WEIGHT * good
            if binomial_at_most(rejected, total, risk) > level:
                break
            if gain > best:
                best = gain
                cutoffs[stratum][rule] = cutoff
    return cutoffs


def verdict(cutoffs: dict[str | None, dict[str, float]]) -> Column:
    """True where a text passes the base rules and no chosen cutoff of its stratum rejects it."""
    passes = F.lit(True)
    for rule, value in _values().items():
        limits = [(s, c[rule]) for s, c in cutoffs.items() if rule in c and s is not None]
        limit = F.lit(None).cast("double")
        if limits:
            limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("stratum")]
        if None in cutoffs and rule in cutoffs[None]:
            limit = F.when(F.col("stratum").isNull(), F.lit(cutoffs[None][rule])).otherwise(limit)
        passes = passes & F.coalesce(value <= limit, F.lit(True))
    return ~base_failed() & passes


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The statistics with ``base_failed`` and ``kept``."""
    rows = stage(statistics(docs, stratum))
    # Nothing else is learned from the labels, so all of them are holdout.
    cutoffs = choose_cutoffs(rows, labels, risk, delta)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", verdict(cutoffs))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    values = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
        "bang_share": "n_bang / greatest(word_chars, 1)",
        "long_words": "word_chars / greatest(n_words, 1)",
        "short_words": "-(word_chars / greatest(n_words, 1))",
    }
    grid = ", ".join(f"('{rule}', {k}, CAST({c!r} AS DOUBLE))" for rule, cutoffs in GRIDS.items() for k, c in enumerate(cutoffs))
    each = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, CAST({v} AS DOUBLE) AS value FROM judged" for rule, v in values.items())
    word, log = r"[^\x20\x09-\x0D]", "lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1)"
    return rf"""
WITH t AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
stats AS (
  SELECT t.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(replace(text, '!', '')) AS n_bang
  FROM t JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
measured AS ({each}),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, k, cutoff)),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT m.* , quality FROM measured m JOIN known USING (doc_id) WHERE NOT base_failed),
totals AS (
  SELECT stratum, rule, count(*) FILTER (quality = 1) AS total,
         {DELTA!r} / ((SELECT count(DISTINCT coalesce(stratum, chr(1))) FROM held) * {len(GRIDS)}) AS level
  FROM held GROUP BY stratum, rule),
tried AS (
  SELECT h.stratum, h.rule, k, cutoff, count(*) FILTER (quality = 1 AND value > cutoff) AS good,
         count(*) FILTER (quality <> 1 AND value > cutoff) AS bad
  FROM held h JOIN grid USING (rule) GROUP BY h.stratum, h.rule, k, cutoff),
tested AS (
  SELECT tried.*, bad - {GOOD_WEIGHT} * good AS gain,
         good < total AND list_sum(list_transform(range(0, good + 1), lambda i:
           exp({log} + i * ln({RISK!r}) + (total - i) * ln(1 - {RISK!r})))) <= level AS valid
  FROM tried JOIN totals ON totals.rule = tried.rule AND totals.stratum IS NOT DISTINCT FROM tried.stratum),
passed AS (
  SELECT *, bool_and(valid) OVER (PARTITION BY stratum, rule ORDER BY k) AS usable FROM tested),
chosen AS (
  SELECT stratum, rule, cutoff FROM passed WHERE usable AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, k) = 1),
rejected AS (
  SELECT DISTINCT doc_id FROM measured m JOIN chosen c ON c.rule = m.rule AND c.stratum IS NOT DISTINCT FROM m.stratum
  WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged"""


OP7_SQL = _sql()
