import base64
import random
import zlib

import numpy as np
import pytest
from conftest import rows
from texts import documents, edges, frame

from lodestar.llm import language, quality


@pytest.fixture(scope="module")
def known():
    return documents(n=400)


def labels(spark, known):
    found = [(d, q) for d, _, _, q in known] + [(None, 1), (5, None), (5, 1), (10**6, 0)]
    return spark.createDataFrame(found, "doc_id bigint, quality int")


def test_quality_of_held_out_documents(spark, known):
    docs = frame(spark, known + edges())
    got = quality.classify(docs, labels(spark, known))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows(got.where("doc_id IS NOT NULL"))
    assert len(got) == len(known) + sum(d is not None for d, _ in edges())
    truth = {d: q for d, _, _, q in known}
    right = []
    for doc_id, held_out, score, predicted in got:
        assert held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= score <= 1 and predicted == (score >= 0.7)
        if held_out and doc_id in truth:
            right.append(predicted == truth[doc_id])
    assert np.mean(right) > 0.95


def test_quality_without_labels_or_rows(spark, known):
    docs = frame(spark, known[:20])
    none = labels(spark, []).where("false")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    one = labels(spark, known).where("quality = 1")
    assert len({r["score"] for r in quality.classify(docs, one).collect()}) == 1
    assert quality.classify(docs.where("false"), labels(spark, known)).count() == 0


def test_scores_do_not_use_held_out_labels(spark, known):
    docs = frame(spark, known)
    flipped = [(d, t, lang, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q) for d, t, lang, q in known]
    a = quality.classify(docs, labels(spark, known)).select("doc_id", "score")
    b = quality.classify(docs, labels(spark, flipped)).select("doc_id", "score")
    assert rows(a) == rows(b)


def test_accepted_keeps_columns_and_clean_documents(spark, known):
    docs = frame(spark, known)
    kept = quality.accepted(docs, labels(spark, known))
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {d for d, _, _, q in known if q}) > 0.97 * sum(q for *_, q in known)
    assert len(ids & {d for d, _, _, q in known if not q}) < 0.05 * sum(1 - q for *_, q in known)


def test_additive_model_learns_a_pair():
    """Only the pair of two features tells the classes apart; ties of values share a bin."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (3000, 3)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 2] > 1)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.99
    assert {tuple(sorted(p[:2])) for p in model.pairs} >= {(0, 2)}


def test_features_see_the_end_of_a_long_text():
    clean = "some words that differ in every place of the line\n" * 4000
    assert quality.features(clean) != quality.features(clean + "JUNK!! ###" * 50)
    assert quality.features(None) == quality.features("") == quality.features(" \n") == [0.0] * len(quality.FEATURES)


def test_language_of_held_out_documents(spark, known):
    got = language.identify(frame(spark, known + [(d, t, None) for d, t in edges()]))
    truth = {d: lang for d, _, lang, q in known if q}
    found = {r["doc_id"]: r for r in got.where("doc_id < 900").collect()}
    right = [found[d]["lang_pred"] == lang for d, lang in truth.items() if found[d]["held_out"]]
    assert np.mean(right) > 0.97
    for r in found.values():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    odd = {r["doc_id"]: r["lang_pred"] for r in got.where("doc_id >= 900").collect()}
    assert {odd[d] for d in (900, 901, 902, 904, 909)} == {"und"}
    assert {odd[d] for d in (903, 907, 910)} <= {"en", "de", "fr", "es"}


def test_language_with_little_to_learn_from(spark, known):
    docs = frame(spark, [(d, t, None) for d, t, *_ in known[:10]])
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}
    single = frame(spark, [(d, t, "xx") for d, t, *_ in known[:30]] + [(900, "99", None)])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(single).collect()}
    assert got.pop(900) == "und" and set(got.values()) == {"xx"}
    assert language.identify(docs.where("false")).count() == 0


def test_language_families(known):
    texts = [t for _, t, _, _ in known]
    model = language.fit(np.stack([language.vector(t) for t in texts]), [lang for _, _, lang, _ in known])
    assert model.families == ["germanic", "romance"]
    assert set(model.duels) == {("de", "en"), ("es", "fr")}
    assert language.family("pt-BR") == "romance" and language.family("tlh") == "tlh"


def test_identified_keeps_columns(spark, known):
    docs = frame(spark, known + [(d, t, None) for d, t in edges()])
    kept = language.identified(docs)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert {d for d, _, _, q in known if q} <= ids
    assert not ids & {900, 901, 902, 904, 909}


def strange():
    """Texts with letters in none of the languages that are learned."""
    rng = random.Random(4)
    soup = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(n))
    return [
        soup(40), soup(2000), base64.b64encode(rng.randbytes(3000)).decode(), " ".join(f"{rng.getrandbits(32):08x}" for _ in range(200)),
        "Это обычный русский текст о доме и реке, который никто не учил раньше.",
        "Tämä on tavallinen suomenkielinen teksti, jota kukaan ei ole opettanut tälle mallille aikaisemmin.",
    ]


def test_identified_rejects_letters_of_no_language(spark, known):
    docs = frame(spark, known + [(2000 + k, t, None) for k, t in enumerate(strange())])
    ids = {r["doc_id"] for r in language.identified(docs).collect()}
    assert {d for d, _, _, q in known if q} <= ids
    assert not {d for d in ids if d >= 2000}


def test_junk_that_is_learned_from_is_still_rejected(known):
    """A few junk texts with a language among those learned from do not make junk usual."""
    rows = [(t, lang) for _, t, lang, q in known if q] + [(t, "en") for t in strange()[:3]]
    model = language.fit(np.stack([language.vector(t) for t, _ in rows]), [lang for _, lang in rows])
    assert all(model.predict(t)[1] < language.LEAST_SCORE for t in strange())
    assert all(model.predict(t)[1] >= language.LEAST_SCORE for t, _ in rows[:-3])


def test_language_sample_is_held_once_and_given_back(spark, monkeypatch):
    """What is fitted on are the vectors in the order of language and id; their memory goes back before the texts are predicted."""
    fitted, given, real = [], [], language.fit
    monkeypatch.setattr(language, "fit", lambda x, langs: fitted.append((x.copy(), langs)) or real(x, langs))
    monkeypatch.setattr(language, "give_back", lambda: given.append(len(fitted)), raising=False)
    docs = [(9, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (5, "the cat", "en"), (1, "ein haus", "de"), (3, "12", "en"), (None, "no id", "en")]
    language.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    (x, langs), = fitted
    assert langs == ["de", "de", "en", "en"]
    assert (x == [language.vector(t) for t in ("ein haus", "der hund und die katze", "the dog and the cat", "the cat")]).all()
    assert given == [1]
