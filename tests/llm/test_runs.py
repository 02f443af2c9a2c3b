import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from texts import SCHEMA, documents, edges, frame

from lodestar.llm import runs


def brute(words, least=24, times=3):
    """All maximal stretches by trying every period."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, times * q):
                own = words[start : start + length]
                if not any(all(own[k] == own[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.append((start, length, q))
            start = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed):
    """Words as numbers: few letters, runs planted in runs, Fibonacci words, repeats with breaks."""
    rng = random.Random(seed)
    for _ in range(60):
        kind, n = rng.randrange(5), rng.randint(0, 260)
        if kind == 0:
            yield [rng.randrange(2) for _ in range(n)]
        elif kind == 1:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            yield b[:n]
        else:
            found = []
            while len(found) < n:
                unit = [rng.randrange(1 + kind * 2) for _ in range(rng.randint(1, 14))]
                unit = unit * rng.randint(1, 3)
                part = unit * rng.randint(1, 7)
                found += part[: len(part) - rng.randrange(len(unit))]
                if rng.random() < 0.4:
                    found += [rng.randrange(9) for _ in range(rng.randrange(6))]
            yield found[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(runs, "PIECE", 4)
    for words in sequences(seed):
        for least, times in ((24, 3), (6, 3), (4, 2), (2, 2)):
            assert runs.runs_of(words, least, times) == brute(words, least, times)


def test_ordered_positions(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 3)
    rng = random.Random(2)
    order = rng.sample(range(500), 300)
    held, plain = runs.Positions(order[0]), [order[0]]
    for x in order[1:]:
        before = max((p for p in plain if p < x), default=-1)
        after = min((p for p in plain if p > x), default=-1)
        assert held.put(x) == (before, after)
        plain.append(x)
        assert list(held) == sorted(plain) and held.size == len(plain)


def test_windows_that_repeat():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, int(n)) for n in rng.integers(0, 60, 200)]
    for width in (1, 5, 16):
        exact = [len({tuple(p[k : k + width]) for k in range(len(p) - width + 1)}) < max(0, len(p) - width + 1) for p in parts]
        assert runs.repeating(parts, width) == exact
    assert runs.repeating([np.zeros(0, dtype=np.int64)], 16) == [False]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words) if n < 3_000 else None
    if found is None:
        return None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def test_documents(spark, tmp_path):
    docs = [d[:2] for d in documents(n=150) + edges()]
    docs += [(5000 + k, "\n".join(" ".join(f"w{x}" for x in s) for s in (seq[:50], seq[50:]))) for k, seq in enumerate(sequences(9))]
    docs += [(6000, "same " * 2_000), (6001, "a b " * 1_000 + "c d e " * 20), (6002, "été été " * 30)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op13_runs(spark, str(tmp_path)).collect()), key=str)
    want = [expected(*d) for d in docs]
    known = [w for w in want if w is not None]
    # Of the long texts, which brute force does not reach, only the presence is compared.
    assert len(got) == len(docs) and any(w[1] for w in known)
    left = list(got)
    for w in known:
        left.remove(w)
    assert sorted(r[0] for r in left) == sorted(d[0] for d, w in zip(docs, want) if w is None)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_periodic_text():
    """A hundred thousand words of one period, in pieces, and a long text of different words."""
    words = [k % 997 for k in range(100_000)]
    assert runs.runs_of(words) == [(0, 100_000, 997)]
    assert runs.runs_of([5] * 50_000) == [(0, 50_000, 1)]
    assert runs.runs_of(list(range(50_000))) == []
