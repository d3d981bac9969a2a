import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm.canonical import _tables, canonical, canonicalize, in_script, look_alike_classes, look_alike_pairs, unstable_segments

SAME = [("café", "café"), ("ﬁne", "fine"), ("Ａ１．", "A1."), ("a b", "a b"), ("a　b", "a b"), ("a​b⁠﻿", "ab"), ("co­op", "coop"), ("x‑y", "x-y"), ("K", "K"), ("ⅴ", "v"), ("ѕсоре", "scope"), ("ΑΒ", "AB"), ("a\r\nb", "a\nb"), ("e‍́", "é")]
DIFFERENT = [("café", "cafe"), ("A", "a"), ("x²", "x2"), ("a,b", "ab"), ("ü", "u"), ("½", "1/2"), ("a–b", "a-b"), ("a\nb", "a b")]


def test_pairs_of_characters():
    for a, b in SAME:
        assert canonical(a) == canonical(b) == unicodedata.normalize("NFC", b)
    for a, b in DIFFERENT:
        assert canonical(a) != canonical(b)
    assert canonical(None) is None and canonical("") == ""


def whole(text):
    """The fold without isolating segments."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(_tables()[0]))


alphabet = st.one_of(st.sampled_from("aeoAx \ņ́̈​ﬁＡäé­абсй학　"), st.characters(blacklist_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet, max_size=25))
def test_segments_give_what_the_whole_text_gives(text):
    assert canonical(text) == whole(text)
    assert canonical(canonical(text)) == canonical(text)


def test_script_of_words_is_kept():
    once = lambda t: in_script(canonical(t))
    for text in ("СССР хорошо", "Кот сел. Он рос", "Ελλάδα ΑΘΗΝΑ", "plain text ок"):
        assert once(text) == once(canonical(text)) == once(once(text))
    assert once("СССР хорошо") == "СССР хорошо" and once("CCCP хорошо") == "СССР хорошо" and once("хорошo") == "хорошо"
    assert once("ѕсоре") == "scope" and once("a ѕсоре of Kот") == "a scope of Кот" and once("САТ scan") == "CAT scan" and once("Ελλάδα ΑΒ") == "Ελλάδα ΑΒ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("аеорсухКМ фщ.fgd"), st.booleans()), max_size=20))
def test_script_is_the_same_for_texts_that_look_the_same(letters):
    latin = dict(zip("аеорсухКМ", "aeopcyxKM"))
    a, b = "".join(c for c, _ in letters), "".join(latin.get(c, c) if swap else c for c, swap in letters)
    assert in_script(canonical(a)) == in_script(canonical(b))


def test_canonicalize(spark):
    df = spark.createDataFrame([(1, "plain", 7), (2, "ﬁ ѕ", 7), (3, None, 7), (4, "", 7), (5, "ä" * 100000, 7)], "id int, text string, n int")
    got = {r.id: (r.canonical, r.canonical_segments) for r in canonicalize(df, "text").collect()}
    assert got == {1: ("plain", 0), 2: ("fi s", 2), 3: (None, None), 4: ("", 0), 5: ("ä" * 100000, 0)}
    assert unstable_segments("a​b") == 1


def test_look_alike_pairs(spark):
    rows = [(1, "scope"), (2, "ѕсоре"), (3, "scope"), (4, "ѕcope"), (5, "other"), (6, None), (7, "Scope"), (2, "ѕсоре"), (8, "ｓcope")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, raw string")
    got = sorted((r.id_a, r.id_b) for r in look_alike_pairs(df, "id", "text").collect())
    assert got == [(1, 2), (1, 4), (1, 8), (2, 3), (2, 4), (2, 8), (3, 4), (3, 8), (4, 8)]
    assert look_alike_pairs(df.limit(0), "id", "text").count() == 0
    classes = {r.id: (r.class_id, r.n_equal, r.n_forms) for r in look_alike_classes(df, "id", "text").collect()}
    assert classes == {1: (1, 2, 4), 2: (1, 2, 4), 3: (1, 2, 4), 4: (1, 1, 4), 5: (5, 1, 1), 7: (7, 1, 1), 8: (1, 1, 4)}
