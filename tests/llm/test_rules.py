import re
from collections import Counter
from math import comb

import pytest
from texts import documents, edges, frame

from lodestar.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            repeated |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    )


def many():
    tricky = ["a b c a b c", "a b c d a b c", "a a a a", "x\nx\n \ny\nx", "a b c x b c a b c x b", "ab c d a bc d ab c d", " x  x"]
    return documents(n=60) + [(d, t, "en", None) for d, t in edges()] + [(800 + k, t, None, None) for k, t in enumerate(tricky)]


def test_statistics_by_brute_force(spark):
    docs = many()
    got = rules.statistics(frame(spark, [d[:3] for d in docs])).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[n] for n in names)) for r in got)
    assert found == sorted((d if d is not None else -1, *brute(t)) for d, t, *_ in docs)


def test_no_python_in_the_plan(spark):
    judged = rules.judge(frame(spark, [d[:3] for d in many()]), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    statistics = rules.statistics(frame(spark, [d[:3] for d in many()]))
    for df in (judged, statistics):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_binomial():
    for n, p in ((10, 0.3), (40, 0.02)):
        for k in range(n + 1):
            exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert rules.binomial_at_most(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert rules.binomial_at_most(0, 10**6, 0.5) == 0.0


def test_cutoffs_keep_their_risk(spark):
    """Junk is rejected, good documents are not; a stratum with few labels gets no cutoffs."""
    docs = [(d, t, "few" if d % 60 == 0 else "many", q) for d, t, _, q in documents(seed=4, n=900)]
    labels = spark.createDataFrame([(d, q) for d, _, _, q in docs] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    judged = rules.judge(frame(spark, [d[:3] for d in docs]), labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in judged}
    failed = {r["doc_id"]: r["base_failed"] for r in judged}
    good = [d for d, _, _, q in docs if q and not failed[d]]
    junk = [d for d, _, s, q in docs if not q and not failed[d] and s == "many"]
    assert sum(kept[d] for d in good) >= 0.98 * len(good)
    assert sum(kept[d] for d in junk) < 0.2 * len(junk)
    assert all(kept[d] for d, _, s, q in docs if s == "few" and not failed[d])
    assert not any(kept[d] for d in kept if failed[d])


def test_without_labels_and_rows(spark):
    docs = frame(spark, [d[:3] for d in many()])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.judge(docs, none).collect())
    assert rules.judge(docs.where("false"), none).count() == 0
