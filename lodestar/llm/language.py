"""Language identification by hierarchical discrimination.

A document's hashed character n-grams first decide the language family (linear
support vector machines, one family against the rest); inside the family, every
two languages have a machine of their own and the language that wins most of
its duels is predicted. Machines only tell the learned languages apart, so the
score also falls where the n-grams of a text are unusual for all learned ones:
letter soup, encoded data and texts in other languages score near 0.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text where nothing could be learned (empty table, no language given);
with one learned language all others texts get it. Null and empty languages are
not learned from, nor are documents without an id. Votes that tie go to the
larger sum of margins, then to the first language in alphabetical order.
Texts of few distinct n-grams (some words, however often repeated) say little
about what is usual and are given more room. Repeated rows are predicted each;
other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, fold, give_back, keep_rows, map_rows, table

#: Documents the machines are fitted on at most, shared evenly by the languages.
MAX_FIT_ROWS = 6_000
DIMENSIONS = 2048
UNKNOWN = "und"
#: Documents below this score have no language that could be relied on.
LEAST_SCORE = 0.2
#: A text is unusual from so many robust deviations of the texts learned from.
USUAL = 4.0

# Families of ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "malayic": "id ms",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# ASCII characters that are no letters become one kind of gap.
_FOLDED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of damped counts of the byte n-grams (1 to 4) of a whole text."""
    words = text.lower().encode("utf-8", "replace").translate(_FOLDED).split()
    codes = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(dimensions)
    grams = codes
    for size in range(1, 5):
        mixed = grams * np.uint32(2654435761)
        counts += np.bincount(((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(7)) % np.uint32(dimensions), minlength=dimensions)
        if len(codes) <= size:
            break
        grams = grams[:-1] * np.uint32(257) + codes[size:] + np.uint32(size)
    damped = np.sqrt(counts)
    return (damped / max(np.linalg.norm(damped), 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (dual coordinate descent); y is -1 or 1, the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(y))
    norms = np.concatenate([(x[at : at + ROWS] ** 2).sum(1) for at in range(0, len(x), ROWS)])
    # Both classes carry the same weight.
    limit = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            gradient = y[i] * float(w @ x[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def likelihoods(shares: np.ndarray, n: int) -> np.ndarray:
    """Log-likelihoods of n-grams from their summed shares in ``n`` documents, of which one at least is even."""
    extra = max(1.0, 0.01 * n)
    return np.log((shares + extra / len(shares)) / (n + extra))


@dataclass
class Usual:
    """How likely the n-grams of a language's documents are, over these documents."""

    middle: float
    by_gram: float
    spread: float

    def deviations(self, v: np.ndarray, logs: np.ndarray) -> float:
        """By how many deviations the n-grams of a text are less likely than those of the documents."""
        # Squares of a vector are the shares of its n-grams; repeating a text changes nothing.
        distinct = max(1, np.count_nonzero(v))
        return float((self.middle - (v**2) @ logs) / max(np.sqrt(self.by_gram / distinct + self.spread**2), 1e-9))


def usual(x: np.ndarray, others: np.ndarray) -> Usual:
    """Learn from the vectors of one language and the ``others``' log-likelihoods; a document is measured without itself."""
    shares = x.astype(np.float64) ** 2
    total = shares.sum(0)
    found = np.array([own @ np.maximum(likelihoods(total - own, len(x) - 1), others) for own in shares])
    middle = float(np.median(found))
    p, logs = total / total.sum(), np.maximum(likelihoods(total, len(x)), others)
    return Usual(middle, float(p @ logs**2 - (p @ logs) ** 2), 1.4826 * float(np.median(np.abs(found - middle))))


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    duels: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    usual: dict[str, Usual] = field(default_factory=dict)
    likeliest: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        v = vector(text)
        best, sure = 0, 1.0
        if len(self.families) > 1:
            margins = self.family_weights[:, :-1] @ v + self.family_weights[:, -1]
            best = int(margins.argmax())
            sure = _sigmoid(2 * float(margins[best] - np.delete(margins, best).max()))
        inside = self.languages[self.families[best]]
        votes = {lang: [0, 0.0, 1.0] for lang in inside}
        for a, b in combinations(inside, 2):
            w = self.duels[a, b]
            margin = float(w[:-1] @ v + w[-1])
            for lang, own in ((a, margin), (b, -margin)):
                votes[lang][0] += own > 0
                votes[lang][1] += own
                votes[lang][2] = min(votes[lang][2], _sigmoid(4 * own))
        lang = min(inside, key=lambda k: (-votes[k][0], -votes[k][1], k))
        beyond = max(0.0, self.usual[lang].deviations(v, self.likeliest) / USUAL - 1)
        return lang, sure * votes[lang][2] * float(np.exp(-8 * beyond))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    known = sorted(set(langs))
    model = LanguageModel(families=sorted({family(k) for k in known}))
    of = np.array(langs)
    families = np.array([family(k) for k in langs])
    model.languages = {f: [k for k in known if family(k) == f] for f in model.families}
    if len(model.families) > 1:
        model.family_weights = np.stack([svm(x, np.where(families == f, 1.0, -1.0)) for f in model.families])
    for inside in model.languages.values():
        for a, b in combinations(inside, 2):
            rows = (of == a) | (of == b)
            model.duels[a, b] = svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))
    logs = {k: likelihoods((x[of == k].astype(np.float64) ** 2).sum(0), int((of == k).sum())) for k in known}
    none = np.full(x.shape[1], -np.inf)
    model.usual = {k: usual(x[of == k], np.max([none, *(logs[o] for o in known if o != k)], axis=0)) for k in known}
    # A passage in another learned language is nothing unusual.
    model.likeliest = np.max([none, *logs.values()], axis=0)
    return model


def learn(docs: DataFrame, max_rows: int = MAX_FIT_ROWS, seed: int = 1) -> LanguageModel:
    """Fit on documents ``(doc_id, text, lang)``, ``max_rows`` at most, thinned by a hash of the id within each language."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang <> ''").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel()
    share = max(1, max_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, share / n) * (1 << 40)))])

    def start():
        def vectors(batch):
            rows = [r for r in zip(batch["doc_id"], batch["lang"], batch["text"]) if has_letter(r[2])]
            return {"doc_id": [r[0] for r in rows], "lang": [r[1] for r in rows], "x": [vector(r[2]).tobytes() for r in rows]}

        return vectors

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_rows(known.where(draw < limit[F.col("lang")]), f"doc_id {kind}, lang string, x binary", start, rows=ROWS).toArrow()
    if not sample.num_rows:
        return LanguageModel()
    chosen = sample.select(["lang", "doc_id"]).to_pandas().sort_values(["lang", "doc_id"], kind="stable").groupby("lang").head(2 * share)
    # The vectors are held once, not as objects beside the table they came in.
    x = np.empty((len(chosen), DIMENSIONS), dtype=np.float32)
    for row, at in zip(x, chosen.index):
        row[:] = np.frombuffer(sample["x"][at].as_buffer(), dtype=np.float32)
    del sample
    model = fit(x, chosen["lang"].tolist())
    del x
    give_back()
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for documents ``(doc_id, text)``."""

    def start():
        def run(batch):
            found = [model.predict(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, lang_pred string, score double", start)


def identify(docs: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; documents whose fold is 0 of 5 are held out of learning."""
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0), max_rows)
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all columns, whose language is found with a score of ``least`` or more."""
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0))

    def sure(text):
        lang, score = model.predict(text)
        return lang != UNKNOWN and score >= least

    return keep_rows(docs, "text", lambda: lambda texts: [sure(t) for t in texts])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
