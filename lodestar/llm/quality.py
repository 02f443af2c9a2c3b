"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features learns one lookup table per
feature, then one per selected pair of features; a document's score is the
logistic function of the sum of its table entries.

Defined cases: a null text counts as empty; an empty or blank text has all-zero
features and gets a score like any other; repeated rows are scored each; ties
of feature values share a bin; an empty table gives no rows, and without
labelled rows of both classes the score is the constant share of label 1 (0.5
without any labelled row). Labels with a null key or value are not used; a
document whose id is null is scored, and never learned from. Other columns of
the input are neither read nor returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, fold, keep_rows, map_rows, table

#: Labelled rows the model is fitted on at most; more are thinned by a hash of the id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.7
WINDOW = 64

FEATURES = [
    "log_chars", "log_words", "word_len", "upper", "digit", "symbol", "bang", "pipe", "other_punct",
    "non_ascii", "distinct", "adjacent", "dup_lines", "line_words",
    "worst_upper", "worst_symbol", "worst_bang", "worst_adjacent",
]


def _byte_class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(chars)] = True
    return mask


_SYMBOLS = b"#*$%&|<>"
_CLASSES = {
    "upper": _byte_class(bytes(range(65, 91))),
    "digit": _byte_class(b"0123456789"),
    "symbol": _byte_class(_SYMBOLS),
    "bang": _byte_class(b"!"),
    "pipe": _byte_class(b"|"),
    "other_punct": _byte_class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _SYMBOLS + b"!.,")),
    "non_ascii": _byte_class(bytes(range(128, 256))),
}


def _worst(marks: np.ndarray, size: int) -> float:
    """Largest share of marks in a window; windows see junk that a long clean part would water down."""
    n = len(marks)
    if not n:
        return 0.0
    starts = np.arange(0, max(1, n - size // 2), size)
    return float((np.add.reduceat(marks, starts, dtype=np.float64) / np.diff(starts, append=n)).max())


def features(text: str | None) -> list[float]:
    """The features of a whole text; all zero for an empty one."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(data, dtype=np.uint8)
    histogram = np.bincount(codes, minlength=256)
    n = len(codes)
    share = {name: histogram[mask].sum() / n for name, mask in _CLASSES.items()}
    count = len(words)
    repeats = np.fromiter(map(eq, words[1:], words), dtype=np.float64, count=count - 1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    worst = {name: _worst(_CLASSES[name][codes], 400) for name in ("upper", "symbol", "bang")}
    return [
        math.log1p(n), math.log1p(count), n / count, share["upper"], share["digit"], share["symbol"],
        share["bang"], share["pipe"], share["other_punct"], share["non_ascii"], len(set(words)) / count,
        float(repeats.mean()) if count > 1 else 0.0, 1 - len(set(lines)) / len(lines), math.log1p(count / len(lines)),
        worst["upper"], worst["symbol"], worst["bang"], _worst(repeats, WINDOW),
    ]


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; ``tables[i]`` belongs to feature i, ``pairs`` to two features."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, i], side="right")]
        for i, j, cuts_i, cuts_j, values in self.pairs:
            at = np.searchsorted(cuts_i, x[:, i], side="right"), np.searchsorted(cuts_j, x[:, j], side="right")
            total += values[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    levels = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))
    distinct = np.unique(values)
    # Halfway to the next lower value, so that equal values share a bin.
    below = distinct[np.maximum(np.searchsorted(distinct, levels) - 1, 0)]
    return np.unique((levels + below) / 2)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float, least: float) -> np.ndarray:
    """Step values of a tree over ordered bins: the best splits are made one after another."""
    parts = [(0, len(g))]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            lg, lh = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
            rg, rh = cg[b] - cg[a] - lg, ch[b] - ch[a] - lh
            gain = lg**2 / (lh + damp) + rg**2 / (rh + damp) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
            gain[(lh < least) | (rh < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + 1 + at)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return step


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 120,
    pair_rounds: int = 40,
    n_pairs: int = 6,
    bins: int = 48,
    pair_bins: int = 8,
    rate: float = 0.15,
    leaves: int = 3,
    damp: float = 2.0,
    least: float = 1.0,
) -> AdditiveModel:
    """Boost one feature after another, then the pairs that explain most of what is left."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return AdditiveModel(intercept=math.log(share / (1 - share)))
    mean = y.mean()
    model = AdditiveModel(intercept=math.log(mean / (1 - mean)))
    model.cuts = [_cut_points(x[:, i], bins) for i in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, at in enumerate(binned):
            g, h = residual()
            size = len(model.tables[i])
            step = rate * _shallow_tree(np.bincount(at, g, size), np.bincount(at, h, size), leaves, damp, least)
            model.tables[i] += step
            total += step[at]

    coarse = [_cut_points(x[:, i], pair_bins) for i in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]
    g, h = residual()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            size = (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            at = cells[i] * (len(coarse[j]) + 1) + cells[j]
            gg, hh = np.bincount(at, g, size), np.bincount(at, h, size)
            gains.append((float((gg**2 / (hh + 4 * damp)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, _, _, values in model.pairs:
            g, h = residual()
            at, shape = cells[i] * values.shape[1] + cells[j], values.shape
            gg = np.bincount(at, g, values.size).reshape(shape)
            hh = np.bincount(at, h, values.size).reshape(shape)
            values_step = rate * _quadrants(gg, hh, 2 * damp, least)
            values += values_step
            total += values_step.ravel()[at]
    return model


def _quadrants(g: np.ndarray, h: np.ndarray, damp: float, least: float) -> np.ndarray:
    """Step values of a depth-2 tree with one cut in each of the two features."""
    rows, columns = g.shape
    if rows < 2 or columns < 2:
        return np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, left - a, whole - top - left + a]
    pg, ph = parts(cg), parts(ch)
    gain = sum(a**2 / (b + damp) for a, b in zip(pg, ph))
    gain = np.where(np.minimum.reduce(ph) < least, -1, gain)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[r, c] <= 0:
        return np.zeros(g.shape)
    value = [a[r, c] / (b[r, c] + damp) for a, b in zip(pg, ph)]
    step = np.empty(g.shape)
    step[: r + 1, : c + 1], step[: r + 1, c + 1 :] = value[0], value[1]
    step[r + 1 :, : c + 1], step[r + 1 :, c + 1 :] = value[2], value[3]
    return step


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, seed: int = 1) -> AdditiveModel:
    """Fit on the documents ``(doc_id, text)`` that have a label in ``labels`` ``(doc_id, quality)``.

    ``max_rows`` labels, about, are drawn by a hash of the id. An id with several labels takes the smaller one.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    part = min(1.0, max_rows / max(1, known.count()))
    if part < 1.0:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < int(part * (1 << 40)))

    def start():
        return lambda rows: {"doc_id": rows["doc_id"], "y": rows["y"], "x": [features(t) for t in rows["text"]]}

    # Twice the number that is wanted is never reached by chance: the broadcast is bounded.
    drawn = docs.select("doc_id", "text").join(F.broadcast(known.limit(2 * max_rows)), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_rows(drawn, f"doc_id {kind}, y int, x array<double>", start, rows=ROWS).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(dtype=np.float64))


def scores(model: AdditiveModel, texts: list[str | None]) -> np.ndarray:
    """Scores of a batch of whole texts: the model's tables are looked up for all of them at once."""
    return model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for documents ``(doc_id, text)``.

    ``labels`` is ``(doc_id, quality)``; rows whose fold is 2 of 4 are held out of learning.
    """
    model = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2), max_rows)

    def start():
        return lambda rows: {"doc_id": rows["doc_id"], "score": scores(model, rows["text"])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, score double", start)
    held_out = fold(F.col("doc_id"), 4) == 2
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all columns, that the classifier does not reject; it learns from the labels of all folds but the held out one."""
    model = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return keep_rows(docs, "text", lambda: lambda texts: scores(model, texts) >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
