import numpy as np
from pyspark.sql import functions as F

from memlake.llm import languages as L

TEXTS = {
    "en": "the cat is on the table and we have not seen it since the morning",
    "de": "wir haben die katze heute nicht gesehen und sie ist auf dem tisch",
    "fr": "nous avons vu le chat sur la table et il ne veut pas partir avec nous",
    "ru": "мы не видели кошку сегодня и она на столе",
    "nl": "wij hebben de kat niet gezien en hij ligt op de tafel met het boek",
}


def scores(spark):
    rows = [(i, t, lang, "x") for lang, t in TEXTS.items() for i in range(5)]
    return L.fit_word_scores(spark.createDataFrame(rows, "id int, text string, lang string, word string"), "text", "lang", "id")


def test_documents(spark):
    s = scores(spark)
    mixed = "Wir haben die Katze heute nicht gesehen. The cat is on the table and we have not seen it.\n> user: Nous avons vu le chat sur la table."
    df = spark.createDataFrame([(1, TEXTS["en"]), (2, mixed), (3, None), (4, ""), (5, "lib/x_y.py #4 v1.2"), (6, TEXTS["ru"]), (6, TEXTS["ru"]), (7, TEXTS["de"].upper())], "id int, text string")
    rows = L.document_languages(df, "id", "text", s)
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, set()).add(r.lang)
        assert 0 <= r.confidence <= 1
    assert got == {1: {"en"}, 2: {"de", "en", "fr"}, 6: {"ru"}, 7: {"de"}}
    segs = [(r.lang, r.first, r.end) for r in L.language_segments(df.where("id = 2"), "id", "text", s).orderBy("first").collect()]
    assert [x[0] for x in segs] == ["de", "en", "fr"] and segs[0][1:] == (0, 7) and segs[1][1] == 7
    assert L.document_languages(df.limit(0), "id", "text", s).count() == 0


def test_borrowed_words_do_not_switch(spark):
    s = scores(spark)
    df = spark.createDataFrame([(1, "the cat is on the table mit dem and we have not seen it since the morning")], "id int, text string")
    assert [r.lang for r in L.document_languages(df, "id", "text", s).collect()] == ["en"]


def test_short_sentences_unseen_words_and_scripts(spark):
    """What has no whole sentence still gets a language, with a low confidence; scripts exclude languages."""
    s = scores(spark)
    texts = ["die Katze!", "gesehenes", "котик", "ok", "Tindren", "the cat и мы не видели кошку and the table"]
    got = {r.id: (r.lang, r.whole, r.confidence) for r in L.document_languages(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", s).collect()}
    assert got[0][:2] == ("de", 0) and got[1][:2] == ("de", 0) and got[2][:2] == ("ru", 0) and max(got[i][2] for i in range(3)) < 0.9
    assert 4 not in got and got[5][1] == 1
    spans = [(r.lang, r.first, r.end) for r in L.language_segments(spark.createDataFrame([(1, texts[5])], "id int, text string"), "id", "text", s).orderBy("first").collect()]
    assert spans == [("en", 0, 2), ("ru", 2, 7), ("en", 7, 10)]
    one = L.language_segments(spark.createDataFrame([(1, "Wir haben die Katze. Sie ist auf dem Tisch.")], "id int, text string"), "id", "text", s).collect()
    assert [(r.lang, r.first, r.end) for r in one] == [("de", 0, 9)]


def test_viterbi_as_brute_force():
    rng = np.random.default_rng(4)
    counts = np.array([4, 1, 3])
    score = rng.normal(0, 4, (8, 8)).astype(np.float32)
    opens = rng.random(8) < 0.4
    starts = np.cumsum(counts) - counts
    got = L._viterbi(score, opens, starts, counts)

    def value(path, a):
        v = score[a, path[0]]
        for t in range(1, len(path)):
            v += score[a + t, path[t]] - (0 if path[t] == path[t - 1] else L.SWITCH_AT_SENTENCE if opens[a + t] else L.SWITCH)
        return v

    for a, n in zip(starts, counts):
        best = max(np.ndindex(*[8] * n), key=lambda p: value(p, a))
        assert abs(value(best, a) - value(got[a : a + n], a)) < 1e-4


def test_codes(spark):
    raw = ["en", "EN", "en_GB", "pt-BR", "Deutsch", "français", "ger", "русский", "", None, "und", "n/a", "sv", "de-AT-x"]
    got = [r.c for r in spark.createDataFrame([(x,) for x in raw], "x string").select(L.language_code(F.col("x")).alias("c")).collect()]
    assert got == ["en", "en", "en", "pt", "de", "fr", "de", "ru", None, None, None, None, None, "de"]
