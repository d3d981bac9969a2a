"""One canonical form for texts that look the same.

The form is NFC after these folds: width, font and small variants, ligatures and roman-numeral or other sign
variants of letters become plain letters; every space separator is a space; every kind of hyphen is ``-``;
letters of other scripts with the shape of a Latin letter become that letter, so that two texts that look the
same become equal; invisible characters are dropped; line ends are ``\\n``. Visible accents, case, digits,
superscripts and other marks stay.

That form is the key of comparisons. The form that ``canonicalize`` puts out is as unique, but keeps the script of
real Cyrillic and Greek: ``in_script`` gives a word with a letter that only its script has the letters of that
script again, and a word of shared shapes only those of most other words of the text. Both are told by letters
that look like no other, so texts that look the same still become equal.

Only unstable segments are normalized. A character is stable if the fold leaves it alone and it can't
combine with the character before it (the quick check of normalization form C). A segment is a run of
unstable characters together with the one stable character before it, which is the boundary context that a
combining mark may join; the canonical segments are spliced between the untouched stretches.

Defined results: null stays null, the empty text stays empty, texts of any length are processed whole, and
the fold is idempotent.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import written

# Letters of other scripts whose shape is that of a Latin letter.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТХУЅІЈҺԚԜӀҮ", "aeopcyxsijhdqwlABEKMHOPCTXYSIJhQWIY"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳͿϹ", "ABEZHIKMNOPTYXovcjJC"))
OTHER = {"օ": "o", "Օ": "O", "ѵ": "v"}
# Code points drawn as a hyphen.
HYPHENS = "‐‑‒⁃−˗﹘﹣－"
# Invisible code points outside the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"

_FOLDED = ("<wide>", "<narrow>", "<font>", "<small>", "<noBreak>")
_RANGES = ((0x0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


def _plain(c: str) -> str:
    """The fold of one code point before composition."""
    kind = unicodedata.category(c)
    if c in HYPHENS:
        return "-"
    if c == "\r":
        return ""
    if kind == "Cf" or c in INVISIBLE or "︀" <= c <= "️" or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    for table in (CYRILLIC, GREEK, OTHER):
        if c in table:
            return table[c]
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if not tag:
        return c
    if tag in _FOLDED:
        return "".join(_plain(chr(int(x, 16))) for x in rest.split())
    if tag == "<compat>" and c != "ſ":
        whole = unicodedata.normalize("NFKD", c)
        if whole.isalpha():
            return "".join(map(_plain, whole))
    if tag[0] != "<":
        return "".join(map(_plain, unicodedata.normalize("NFD", c)))
    return c


@functools.cache
def _tables() -> tuple[dict[int, str], re.Pattern, frozenset]:
    fold, unstable = {}, set()
    for lo, hi in _RANGES:
        for i in range(lo, hi):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            to = _plain(c)
            if to != c:
                fold[i] = to
            parts = unicodedata.decomposition(c)
            if parts and parts[0] != "<" and len(parts.split()) == 2:
                unstable.add(int(parts.split()[1], 16))  # it may combine with the character before
            if unicodedata.combining(c) or unicodedata.normalize("NFC", to) != c:
                unstable.add(i)
    unstable |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul
    spans, last = [], None
    for i in sorted(unstable):
        if last is not None and i == last[1] + 1:
            last[1] = i
        else:
            last = [i, i]
            spans.append(last)
    body = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in spans)
    return fold, re.compile(f"[{body}]+"), frozenset(map(chr, unstable))


@functools.lru_cache(1 << 16)
def _segment(segment: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment).translate(_tables()[0]))


def _segments(text: str):
    """The bounds of each unstable segment: a run of unstable characters and the character before it."""
    _, run, unstable = _tables()
    if not unstable.isdisjoint(text):
        for m in run.finditer(text):
            yield max(m.start() - 1, 0), m.end()


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if text is None or (text.isascii() and "\r" not in text):
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at = [], 0
    for a, b in _segments(text):
        out += (text[at:a], _segment(text[a:b]))
        at = b
    return "".join(out) + text[at:] if out else text


# Of the letters above, those of the Russian and Greek alphabets; the rest counts as Latin.
_BACK = {
    "CYRILLIC": str.maketrans({CYRILLIC[c]: c for c in "аеорсухАВЕКМНОРСТХУ"}),
    "GREEK": str.maketrans({GREEK[c]: c for c in "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"}),
}
_WORD = re.compile(r"[^\W\d_]+")
_CYRILLIC_LETTER, _GREEK_LETTER = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]")


def in_script(text: str) -> str:
    """A canonical text with the letters of real Cyrillic and Greek words in their own script."""
    if not _CYRILLIC_LETTER.search(text) and not _GREEK_LETTER.search(text):
        return text
    shared = {k: frozenset(map(chr, t)) for k, t in _BACK.items()}

    def script(word: str) -> str | None:
        """The script that a letter of the word can only be of; None if no letter says."""
        for name, pattern in (("CYRILLIC", _CYRILLIC_LETTER), ("GREEK", _GREEK_LETTER)):
            if pattern.search(word):
                rest = pattern.sub("", word)
                return name if shared[name].issuperset(rest) else "LATIN"
        return None if shared["CYRILLIC"].issuperset(word) or shared["GREEK"].issuperset(word) else "LATIN"

    words = {w: script(w) for w in set(_WORD.findall(text))}
    votes = {k: sum(v == k for v in words.values()) for k in ("LATIN", "CYRILLIC", "GREEK")}
    most = max(votes, key=votes.get)

    def restored(m: re.Match) -> str:
        w = m[0]
        kind = words[w] or most
        return w.translate(_BACK[kind]) if kind in _BACK and shared[kind].issuperset(x for x in w if x < "\u0370") else w

    return _WORD.sub(restored, text)


def unstable_segments(text: str | None) -> int | None:
    """How many segments of a text are not in canonical form; carriage returns count one by one."""
    return None if text is None else _folded(text)[1]


def _folded(text: str) -> tuple[str, int]:
    """The canonical form of a text and how many of its segments were changed, in one pass."""
    if text.isascii():
        return canonical(text), text.count("\r")
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    out, at, n = [], 0, 0
    for a, b in _segments(text):
        to = _segment(text[a:b])
        out += (text[at:a], to)
        n += to != text[a:b]
        at = b
    return "".join(out) + text[at:], n


def canonicalize(df: DataFrame, column: str, to: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``column`` and the number of segments changed.

    ASCII texts are already canonical and never leave the JVM.
    """
    plain = (F.octet_length(column) == F.char_length(column)) & ~F.contains(F.col(column), F.lit("\r"))

    @F.pandas_udf("text string, n int")
    def fold(s):
        import pandas as pd

        both = [_folded(t) for t in s]
        return pd.DataFrame({"text": [in_script(t) for t, _ in both], "n": pd.array([n for _, n in both], "Int32")})

    easy = df.where(plain | F.col(column).isNull()).withColumns({to: F.col(column), f"{to}_segments": F.when(F.col(column).isNotNull(), F.lit(0))})
    hard = df.where(~plain).withColumn("_fold", fold(column)).withColumns({to: F.col("_fold.text"), f"{to}_segments": F.col("_fold.n")}).drop("_fold")
    return easy.unionByName(hard)


def _forms(id_column: str, column: str):
    import hashlib

    def run(batches):
        for b in batches:
            texts = b.column(column).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {id_column: b.column(id_column), "form": pa.array([hashlib.md5(canonical(t).encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()), "raw": b.column("raw")}
            )

    return run


def _form_rows(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, form, raw) of every text: the hash of its form of comparison and of its code points."""
    id_type = df.schema[id_column].dataType.simpleString()
    rows = df.select(id_column, column).where(F.col(column).isNotNull()).withColumn("raw", F.unhex(F.md5(column)))
    plain = (F.octet_length(column) == F.char_length(column)) & ~F.contains(F.col(column), F.lit("\r"))
    easy = rows.where(plain).select(id_column, F.col("raw").alias("form"), "raw")
    hard = rows.where(~plain).mapInArrow(_forms(id_column, column), f"{id_column} {id_type}, form binary, raw binary")
    return written(easy.unionByName(hard))


def look_alike_pairs(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id_a, id_b): rows whose texts look the same but are not the same code points, the smaller id first.

    Rows are first counted into classes of equal texts. Classes of one form are paired, and only then expand to
    their members, so a class with a third of all rows makes no row that is not a result. Null texts are in no pair.
    """
    rows = _form_rows(df, id_column, column)
    classes = rows.groupBy("form", "raw").agg(F.lit(1).alias("one"))
    mixed = classes.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    some = written(classes.join(mixed, "form", "left_semi").select("form", "raw"))
    pairs = some.join(some.withColumnRenamed("raw", "other"), "form").where("raw < other").select("raw", "other")
    members = rows.join(some, ["form", "raw"], "left_semi").select("raw", F.col(id_column).alias("id")).distinct()
    a, b = members.select("raw", F.col("id").alias("a")), members.select(F.col("raw").alias("other"), F.col("id").alias("b"))
    wide = pairs.join(a, "raw").join(b, "other").where("a <> b")
    return wide.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_alike_classes(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, class_id, n_equal, n_forms): the look-alike class of every text, named by its smallest id.

    ``n_equal`` counts the rows of the same code points, ``n_forms`` the different texts that look the same.
    """
    rows = _form_rows(df, id_column, column).withColumnRenamed(id_column, "id")
    classes = rows.groupBy("form", "raw").agg(F.count("*").alias("n_equal"), F.min("id").alias("least"))
    forms = classes.groupBy("form").agg(F.count("*").alias("n_forms"), F.min("least").alias("class_id"))
    return rows.join(classes.drop("least"), ["form", "raw"]).join(forms, "form").select("id", "class_id", "n_equal", "n_forms")
