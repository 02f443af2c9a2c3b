import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import SCHEMA, documents, edges, frame
from tokenizers import Tokenizer

from lodestar.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def aligner():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def whole_groups(libraries, text):
    """Groups of a text, both tokenizers run over all of it: lists of (A ids, B ids)."""
    if not text:
        return None
    a, b = libraries
    raw = f" {text}".encode()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}
    side_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    side_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in side_a) != raw or b"".join(x for _, x in side_b) != raw:
        return None
    ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
    ends_a, ends_b = ends(side_a), ends(side_b)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(([x for x, _ in side_a[i:k]], [x for x, _ in side_b[j:m]]))
        i, j = k, m
    return groups


def brute(libraries, docs):
    found = [(d, whole_groups(libraries, t)) for d, t in docs]
    links = [Counter((x, y) for a, b in groups or [] for x in a for y in b) for _, groups in found]
    counts = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    rows = []
    for (doc_id, groups), own in zip(found, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        rows.append((
            doc_id, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), sum(own.values()),
            sum(n for p, n in own.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(rows, key=str)


def odd_texts(seed=3, n=120):
    """White space of all kinds, marks, scripts, digits and tokens' own strings."""
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\n\n", "\xa0", "　", "\x1c", "a", "the", "house", "été", "größe", "日本語", "кошка", "123", "4567", "...", "'s", "!?", "#", "\U0001f600", "é", "<s>", "<|endoftext|>", "\x00", "x\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)] + [" ", "\n", "  a", "a ", "▁", "a▁b", "▁ x"]


def test_texts_by_the_libraries(libraries, aligner):
    """Whole texts, and texts put together from stretches, by the libraries' own ids."""
    texts = [*odd_texts(), *[t for _, t, *_ in documents(n=30)]]
    found = aligner.texts(texts)
    wanted = [whole_groups(libraries, t) for t in texts]
    assert [fine for *_, fine in found] == [w is not None for w in wanted]
    sound = [(a, b) for a, b, fine in found if fine]
    groups, owner = aligner.groups([a for a, _ in sound], [b for _, b in sound])
    lines = [";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in w).encode() for w in wanted if w]
    assert alignment.written(groups, owner, len(sound)) == lines
    for text, (a, b, fine) in zip(texts, found):
        units = alignment._UNITS.findall(f" {text}")
        assert "".join(units) == f" {text}"
        spans = [aligner.span(u) for u in units]
        assert all(s[2] for s in spans) == fine
        assert np.concatenate([s[0] for s in spans]).tolist() == a.tolist() and np.concatenate([s[1] for s in spans]).tolist() == b.tolist()


def test_fragments_compose_associatively():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2)]
        a, b = (np.array(e) for e in ends)
        ids_a, ids_b = np.arange(len(a), dtype=np.int32), np.arange(100, 100 + len(b), dtype=np.int32)
        whole = alignment.fragment(ids_a, a, ids_b, b)
        borders = sorted({0, n, *rng.sample(range(n + 1), min(n, rng.randint(0, 8)))})
        parts = []
        for low, high in zip(borders, borders[1:]):
            x, y = (a > low) & (a <= high), (b > low) & (b <= high)
            parts.append(alignment.fragment(ids_a[x], a[x], ids_b[y], b[y]))
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            size = rng.randint(2, 3)
            parts[k : k + size] = [alignment.join(parts[k : k + size] + [alignment.NEUTRAL] * rng.randrange(2))]
        for got, want in zip(parts[0], whole):
            assert np.array_equal(got, want)


def test_links_of_large_groups():
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 100, 20).astype(np.int32), rng.integers(1, 100, 20).astype(np.int32)
    groups = alignment.Groups(rng.integers(0, 9, n_a.sum()).astype(np.int32), rng.integers(0, 9, n_b.sum()).astype(np.int32), n_a, n_b)
    owner = np.sort(rng.integers(0, 6, 20))
    want, i, j = Counter(), 0, 0
    for x, y, o in zip(n_a, n_b, owner):
        want.update(((int(a) << 32) | int(b), int(o)) for a in groups.a[i : i + x] for b in groups.b[j : j + y])
        i, j = i + x, j + y
    keys, of, times = alignment.linked(groups, owner)
    assert dict(zip(zip(keys.tolist(), of.tolist()), times.tolist())) == want and sorted(keys) == keys.tolist()


def test_ranges_of_a_text():
    texts = [*odd_texts(7, 40), "x" * 500 + " and " + "é" * 300, "　 " * 50, " ".join(["word"] * 200)]
    for text in texts:
        raw = f" {text}".encode()
        borders = {0}
        for unit in alignment._UNITS.findall(f" {text}"):
            borders.add(max(borders) + len(unit.encode()))
        for chunk in (1, 7, 64):
            last = 0
            for low, high, begin, end in alignment.ranges(raw, chunk):
                assert low == last and begin <= low < high <= end and {begin, end} <= borders
                last = high
            assert last == len(raw)


@pytest.mark.parametrize("chunk, fan, sent", [(1 << 16, 8, 10**6), (40, 2, 10**6), (200, 3, 0)])
def test_documents_by_brute_force(spark, libraries, monkeypatch, chunk, fan, sent):
    docs = [d[:2] for d in documents(n=60)] + [(d, t) for d, t in edges() if not t or len(t) < 10_000]
    docs += [(2000 + k, t) for k, t in enumerate(odd_texts())] + [(3000 + k, "one hot text of copies") for k in range(40)]
    if fan == 2:
        monkeypatch.setattr(alignment, "SLICE", 50)
        monkeypatch.setattr(alignment, "HELD_PAIRS", 20)
    docs += [(4000, "no-white-space-" * 60), (4001, "日本語" * 100)]
    got = alignment.aligned(frame(spark, docs), chunk=chunk, fan=fan, sent_pairs=sent)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == brute(libraries, docs)


def test_groups_and_empty_tables(spark, libraries):
    docs = [(k, t) for k, t in enumerate(odd_texts(n=20))] + [(100, None), (101, "")]
    for r in alignment.groups(frame(spark, docs), chunk=64).collect():
        want = whole_groups(libraries, docs[r["doc_id"]][1] if r["doc_id"] < 100 else None)
        assert [r["a"], r["n_a_each"], r["n_b_each"]] == ([[x for a, _ in want for x in a], [len(a) for a, _ in want], [len(b) for _, b in want]] if want else [[], [], []])
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
