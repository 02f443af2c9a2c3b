"""Small documents for the text operators: ordinary, odd and repeated ones."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, start int, slot string, _row int"

WORDS = {
    "en": "the of and to in that is was for on with they house river stone garden window letter morning people never always under between".split(),
    "de": "der die und nicht mit ist auf für über schön straße haus wasser garten fenster immer zwischen können größe müde brücke".split(),
    "fr": "le la les et dans pour avec été où maison rivière fenêtre jardin toujours jamais entre très élève château garçon être".split(),
    "es": "el los las y en para con más también casa río ventana jardín siempre nunca entre niño año corazón mañana señor".split(),
}


def sentence(rng, lang, words):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(words))


def prose(rng, lang, words):
    lines = []
    while words > 0:
        size = min(words, rng.randint(8, 30))
        lines.append(sentence(rng, lang, size).capitalize() + ".")
        words -= size
    return "\n".join(lines)


def junk(rng, lang, words):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "%%%", "&&&"]) for w in sentence(rng, lang, words).split())
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in sentence(rng, lang, words).split())
    return " ".join([rng.choice(WORDS[lang])] * words)


def edges():
    """(doc_id, text) of odd documents; ids repeat and are missing."""
    long_text = prose(random.Random(9), "en", 30_000)
    return [
        (900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "12 34"), (905, "a b c d"), (906, "a b c d e"),
        (907, long_text), (908, long_text), (909, "!!! ???"), (910, "  two  words \n\n"), (None, "no id here, but words"),
        (None, None), (911, "same id"), (911, "same id"), (911, "same id but other text"), (912, "été \U0001f600 \x1c x  y"),
        (913, "<|endoftext|> is text"),
    ]


def documents(seed=1, n=120):
    """(doc_id, text, lang, quality)."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "en", "de", "fr", "es"])
        good = rng.random() < 0.7
        rows.append((k, (prose if good else junk)(rng, lang, rng.randint(60, 200)), lang, int(good)))
    return rows


def frame(spark, rows, parts=3):
    """Documents with extra columns; rows are (doc_id, text[, lang[, source]])."""
    full = []
    for k, row in enumerate(rows):
        doc_id, text, lang, source = (*row, None, None)[:4]
        full.append((doc_id, text, lang, source, len(text or ""), "k", k, k, "s", k))
    return spark.createDataFrame(full, SCHEMA).repartition(parts)
