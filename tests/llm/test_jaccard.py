import random
import re
import tracemalloc

import numpy as np
import pytest
from conftest import rows
from texts import WORDS, edges, frame

from lodestar.llm import jaccard
from lodestar.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(
        ((d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(docs, sets))), key=str
    )


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(rng, base, copies, edits, first):
    """Near copies of a text, each with so many words replaced, at random places."""
    found = []
    for k in range(copies):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        found.append((first + k, " ".join(words)))
    return found


def words(rng, n):
    return " ".join(rng.choice(WORDS["en"]) + str(rng.randrange(30)) for _ in range(n))


def collection(seed):
    rng = random.Random(seed)
    docs = [(1000 + k, words(rng, rng.randint(5, 90))) for k in range(60)]
    docs += family(rng, words(rng, 100), 40, 4, 2000) + family(rng, words(rng, 60), 30, 3, 3000)
    passage = words(rng, 30)
    docs += [(4000 + k, f"{words(rng, rng.randint(0, 9))} {passage} {words(rng, rng.randint(0, 6))}") for k in range(40)]
    docs += [(5000 + k, " ".join(f"w{(k + j) % 14}" for j in range(rng.randint(1, 13)))) for k in range(60)]
    docs += [(6000 + k, docs[rng.randrange(60)][1].upper()) for k in range(30)]
    # Chains of texts that only link with the next one.
    chain = words(rng, 80).split()
    for k in range(12):
        docs.append((7000 + k, " ".join(chain)))
        chain = chain[3:] + words(rng, 3).split()
    return docs + edges()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    docs = collection(seed)
    got = jaccard.classes(frame(spark, docs))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(got) == brute(docs)


@pytest.mark.parametrize("block_pairs", [0, 10**9])
def test_allocation_finds_what_dear_keys_hide(spark, monkeypatch, block_pairs):
    """With a budget of no pairs, keys that are not settled by stars are compared in blocks, or serve for nothing: the fallback finds the rest."""
    monkeypatch.setattr(jaccard, "KEY_PAIRS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_PAIRS", block_pairs)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "_star_pairs", lambda keys: keys.limit(0).selectExpr("sid as a", "sid as b"))
    monkeypatch.setattr(jaccard, "_reordered_star", lambda keys: keys.limit(0).selectExpr("sid as a", "sid as b"))
    docs = collection(3)[:200]
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """A family of which most pairs do not link, so that many components share their keys; hubs and blocks are split."""
    monkeypatch.setattr(jaccard, "STAR_SETS", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 2_500)
    rng = random.Random(6)
    docs = family(rng, words(rng, 120), 160, 9, 100) + family(rng, words(rng, 40), 90, 3, 1000) + collection(6)[:60]
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)


def test_links_of_two_blocks():
    """Links tie exactly the components that pairs of the two blocks, of one block with itself, would."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 9_000, dtype=np.uint64))
    sets = [np.unique(np.where(rng.random(9_000) < 0.01 * k, rng.integers(0, 2**63, 9_000, dtype=np.uint64), base)) for k in range(12)]
    for x, y, blocks in ((1, 2, [1] * 6 + [2] * 6), (3, 3, [3] * 12)):
        roots = [100, 100, 101, 102, 103, 104, 100, 105, 106, 107, 108, 109]
        part = pa.table({"x": [x] * 12, "y": [y] * 12, "block": blocks, "sid": list(range(12)), "component": roots, "tokens": [s.tobytes() for s in sets]})
        want = {r: {r} for r in roots}
        for i in range(12):
            for j in range(12):
                common = len(np.intersect1d(sets[i], sets[j]))
                if blocks[i] == x and blocks[j] == y and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    both = want[roots[i]] | want[roots[j]]
                    want.update({r: both for r in both})
        links = [tuple(r.values()) for r in jaccard._spanning_links(part).to_pylist()]
        got = {r: {r} for r in roots}
        for i, j in links:
            assert got[roots[i]] != got[roots[j]]
            both = got[roots[i]] | got[roots[j]]
            got.update({r: both for r in both})
        assert got == want and links


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH_HOT", 3)
    docs = collection(4)
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)


def test_sizes_at_the_threshold(spark):
    """Pairs of every size that agree on exactly 80 percent, and on a little less."""
    docs = []
    for n in range(1, 60):
        base = [f"n{n}w{k}" for k in range(n + 4)]
        docs += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(base + [f"x{n}-{k}" for k in range(n // 4)]))]
        docs.append((10 * n + 2, " ".join(base + [f"y{n}-{k}" for k in range(n // 4 + 1)])))
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)


def test_bands():
    """A set's partners are in its own band or the next; linked sets differ in at most H n-grams there."""
    for n in [*range(1, 400), 10**4, 10**6]:
        band, last = jaccard.BANDS.of(n), n * 100 // 80
        assert jaccard.BANDS.of(last) in (band, band + 1)
        for larger in {n, last}:
            assert (n + larger) // 9 <= jaccard.BANDS.differ[band] or n < 4
        assert jaccard.BANDS.parts[band] == 1 or jaccard.BANDS.parts[band] > jaccard.BANDS.differ[band]


def test_empty_table(spark):
    assert jaccard.classes(frame(spark, edges()).where("false")).count() == 0
    docs = [(1, None), (2, ""), (3, " ")]
    assert result(jaccard.classes(frame(spark, docs))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def kept_rows(docs):
    """(doc_id, text) that one_of_each keeps, by all pairs of rows: of each component the first by id and text."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    groups = {}
    for k, (d, t) in enumerate(docs):
        groups.setdefault(find(k), []).append((d, t))
    kept = []
    for group in groups.values():
        named = sorted((d, t) for d, t in group if d is not None) if len(group) > 1 else []
        kept += named[:1] + [r for r in group if r[0] is None or len(group) == 1]
    return sorted(kept, key=str)


def test_one_of_each(spark):
    docs = [d[:2] for d in collection(5)]
    shared = [(1, "an own text that links with nothing else"), (1, "one more text of the same id, also alone"), (901, ""), (901, ""), (901, None)]
    near = " ".join(f"w{k}" for k in range(200))
    shared += [(7000, near), (7000, near + " end"), (7001, near), (7001, "different words that nobody else has"), (6999, "some others again, of a smaller id")]
    df = frame(spark, docs + shared)
    kept = jaccard.one_of_each(df)
    assert kept.schema == df.schema
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == kept_rows(docs + shared)


def test_small_batches():
    """Whatever few words the texts of a slice have in all."""
    memo = jaccard.WordHashes()
    for size in range(1, 6):
        for total in range(9):
            words = "a b c d e f g h".split()[:total]
            texts = [" ".join(words[k * total // size : (k + 1) * total // size]) for k in range(size)]
            found = jaccard.shingle_sets(texts, memo)
            assert [len(f) for f in found] == [len(shingle_set(t)) for t in texts]
            again = [jaccard.shingle_sets([t, "x y z and many other words"], memo)[0] for t in texts]
            assert all((a == b).all() for a, b in zip(found, again))


def test_components_of_edges(spark):
    rng = np.random.default_rng(0)
    edges_ = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges_:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges_ + [(1, None), (None, 5), (7, 7)], "a bigint, b bigint")
    nodes = {n for a, b in edges_ if a != b for n in (a, b)}
    assert rows(components(df)) == sorted((n, find(n)) for n in nodes)
    assert components(df.where("false")).count() == 0


def test_segments_of_many_sets_in_little_memory(monkeypatch):
    """The segments of a batch are worked out part by part: the same keys, without arrays over all its n-grams."""
    rng = np.random.default_rng(2)
    tokens = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in rng.integers(20, 3_000, 400)]
    bands, parts = [jaccard.BANDS.of(len(t)) for t in tokens], np.array(jaccard.BANDS.parts)
    with monkeypatch.context() as patched:
        patched.setattr(jaccard, "SEGMENT_GRAMS", 10**9, raising=False)
        want = jaccard._segments(tokens, bands, parts)
    tracemalloc.start()
    got = jaccard._segments(tokens, bands, parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, want))
    assert peak < 3 * sum(t.nbytes for t in tokens)


def jobs_of(spark, run):
    """Stages that ran, and the result."""
    from pyspark import InheritableThread

    group, tracker, found = f"group-{random.random()}", spark.sparkContext.statusTracker(), []

    def work():
        spark.sparkContext.setJobGroup(group, group)
        found.append(run())

    thread = InheritableThread(target=work)
    thread.start()
    thread.join()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return len(stages), found[0]


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """A chain takes rounds, of several stages each; few edges take two jobs, and both ways agree."""
    path = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(k, k) for k in range(5)] + [(900, 800), (800, 900)], "a bigint, b bigint")
    few, got = jobs_of(spark, lambda: rows(components(path)))
    assert got == [(k, 0) for k in range(301)] + [(800, 800), (900, 800)]
    assert few <= 4
    monkeypatch.setattr("lodestar.llm.components.FEW_EDGES", 10, raising=False)
    many, again = jobs_of(spark, lambda: rows(components(path)))
    assert again == got and many > few


def test_another_round_of_stars_only_for_many_pairs(spark, monkeypatch):
    """Keys whose pairs the blocks can compare go there at once; with more pairs the stars are reordered first. Links are the same."""
    called, real = [], jaccard._reordered_star
    monkeypatch.setattr(jaccard, "_reordered_star", lambda keys: called.append(1) or real(keys))
    monkeypatch.setattr(jaccard, "KEY_PAIRS", 4)
    rng = random.Random(8)
    docs = family(rng, words(rng, 120), 60, 9, 100)
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)
    assert not called
    monkeypatch.setattr(jaccard, "STAR_PAIRS", 5, raising=False)
    assert result(jaccard.classes(frame(spark, docs))) == brute(docs)
    assert called


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_verified_pairs_by_either_join(spark, monkeypatch, broadcast_rows):
    """Hubs below and above the size of a group of partners, with sets sent to all tasks or joined."""
    monkeypatch.setattr(jaccard, "STAR_SETS", 4)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    tokens = [np.unique(np.where(rng.random(len(base)) < 0.01 * (k % 20), rng.integers(0, 2**63, len(base), dtype=np.uint64), base)) for k in range(25)]
    sets = spark.createDataFrame([(k, len(t), t.tobytes()) for k, t in enumerate(tokens)], "sid bigint, n bigint, tokens binary")
    pairs = [(a, b) for a in (0, 1, 7, 24) for b in range(25) if a != b and (a != 24 or b < 3)]

    def linked(a, b):
        common = len(np.intersect1d(tokens[a], tokens[b]))
        return 100 * common >= 80 * (len(tokens[a]) + len(tokens[b]) - common)

    got = rows(jaccard._verified(spark.createDataFrame(pairs + pairs[:9], "a bigint, b bigint"), sets))
    assert got == sorted(p for p in pairs if linked(*p)) and 0 < len(got) < len(pairs)
