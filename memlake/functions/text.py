"""Text expressions: everything here is built from JVM-side functions and stays inside code generation.

Defined results: null texts give null or an empty array; lengths that decide are in bytes, cuts are made on
characters, so no character is ever divided.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import lexicons as L

#: Latin, Greek and Cyrillic letters that decompose into a letter and marks, and those letters.
_DECOMPOSED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))}
_ACCENTED, _BARE = "".join(_DECOMPOSED), "".join(_DECOMPOSED.values())


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(_c(c)), _ACCENTED, _BARE), r"\p{M}+", "")


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def trim_space(c: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_one_of(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def query_terms(c: Column | str) -> Column:
    """Words of a free-text query: ASCII words of two or more characters without stop words; all words if none is left."""
    words = F.filter(F.split(F.lower(_c(c)), "[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
    kept = F.filter(words, lambda w: ~is_one_of(w, L.SEARCH_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def keywords(c: Column | str) -> Column:
    """Distinct words of three or more bytes without stop words, in order of appearance."""
    words = F.split(F.lower(_c(c)), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~is_one_of(w, L.KEYWORD_STOP_WORDS)))


def keyword_overlap(words: Column, text: Column | str) -> Column:
    """The share of the keywords that the text contains as substrings; 0 without keywords."""
    low = F.lower(_c(text))
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def has_non_ascii(c: Column | str) -> Column:
    return _c(c).rlike(r"[^\x00-\x7F]")


def _any_of(low: Column, signals: list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | F.contains(low, F.lit(s))
    return out


def classify_query(c: Column | str) -> Column:
    """PREFERENCE, TEMPORAL or FACT; text outside ASCII counts as PREFERENCE, which is served by vectors."""
    low = F.lower(_c(c))
    return F.when(has_non_ascii(c) | _any_of(low, L.PREFERENCE_SIGNALS), "PREFERENCE").when(_any_of(low, L.TEMPORAL_SIGNALS), "TEMPORAL").otherwise("FACT")


def _count(low: Column, word: str) -> Column:
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")


def conversation_room(c: Column | str) -> Column:
    """The room whose words occur most often as substrings, the first declared in a tie; else ``general``."""
    low = F.lower(_c(c))
    counts = []
    for words in L.CONVERSATION_ROOMS.values():
        n = F.lit(0)
        for w in words:
            n = n + _count(low, w)
        counts.append(n)
    best = F.greatest(*counts)
    out = F.when(best <= 0, "general")
    for room, n in zip(L.CONVERSATION_ROOMS, counts):
        out = out.when(n == best, room)
    return out


def path_room(c: Column | str, configured: list[str] = ()) -> Column:
    """The configured room that a path segment names, else the room of the first known segment, else ``general``."""
    parts = F.split(_c(c), "/")
    table = F.create_map(*[F.lit(x) for room, words in L.FOLDER_ROOMS.items() for w in words.split() for x in (w, room)])
    known = F.get(F.filter(F.transform(parts, lambda p: F.element_at(table, F.lower(p))), lambda r: r.isNotNull()), 0)
    out = F.coalesce(known, F.lit("general"))
    if configured:
        own = F.create_map(*[F.lit(x) for r in configured for x in (r.lower(), r)])
        out = F.coalesce(F.get(F.filter(F.transform(parts, lambda p: F.element_at(own, F.lower(p))), lambda r: r.isNotNull()), 0), out)
    return out


def drawer_id(wing: Column | str, room: Column | str, chunk: Column | str) -> Column:
    """The content id of a chunk; the source is no part of it, so equal chunks of two files are one drawer."""
    return F.md5(F.concat(_c(wing), _c(room), _c(chunk)))


def sentences(c: Column | str) -> Column:
    """Pieces that end with ``.``, ``!`` or ``?``, and the rest; trimmed, none blank."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"([^.!?]*[.!?]|[^.!?]+$)"), F.lit(1))
    return F.filter(F.transform(parts, trim_space), lambda s: s != "")


def memory_scores(sentence: Column) -> dict[str, Column]:
    """Per memory type, how many of its markers a sentence contains."""
    low = F.lower(sentence)
    out = {}
    for kind, markers in L.MEMORY_MARKERS.items():
        n = F.lit(0)
        for m in markers:
            n = n + F.contains(low, F.lit(m)).cast("int")
        out[kind] = n
    return out


def exchanges(c: Column | str) -> Column:
    """A transcript cut at ``> user:``: a leading part, then one part per user turn with what follows it."""
    parts = F.split(_c(c), "> user:")
    parts = F.transform(parts, lambda p, i: F.struct(i.alias("i"), trim_space(p).alias("p")))
    return F.transform(F.filter(parts, lambda x: x["p"] != ""), lambda x: F.when(x["i"] > 0, F.concat(F.lit("> user:"), x["p"])).otherwise(x["p"]))


def grouped(parts: Column, size: int) -> Column:
    """Every ``size`` neighbours of an array joined by line breaks."""
    n = F.ceil(F.size(parts) / F.lit(size)).cast("int")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, i * size + 1, size), "\n"))).otherwise(F.array().cast("array<string>"))


def chunks(c: Column | str, size: int = L.CHUNK_BYTES, overlap: int = L.CHUNK_OVERLAP) -> Column:
    """Paragraphs gathered up to ``size`` bytes; a new chunk starts with the end of the one before.

    A paragraph above the size stays whole. The overlap is taken in characters.
    """
    text = trim_space(c)
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trim_space), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s, p):
        cur = s["cur"]
        full = (cur != "") & (F.octet_length(cur) + F.octet_length(p) + 2 > size)
        chunk = trim_space(cur)
        lead = F.when(F.octet_length(chunk) > overlap, F.concat(F.right(chunk, F.lit(overlap)), F.lit("\n\n"))).otherwise("") if overlap > 0 else F.lit("")
        base = F.when(full, lead).otherwise(cur)
        return F.struct(F.when(full, F.concat(s["done"], F.array(chunk))).otherwise(s["done"]).alias("done"), F.when(base != "", F.concat(base, F.lit("\n\n"), p)).otherwise(p).alias("cur"))

    folded = F.aggregate(paragraphs, empty, step, lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(trim_space(s["cur"])))).otherwise(s["done"]))
    return F.when(text == "", F.array().cast("array<string>")).when(F.octet_length(text) <= size, F.array(text)).otherwise(folded)


def shown(c: Column | str, limit: int = 500) -> Column:
    """The text as printed: cut at the limit with three dots."""
    c = _c(c)
    return F.when(F.octet_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def message_line(role: Column | str, content: Column | str) -> Column:
    """A transcript line: ``> user: …`` for users, ``role: …`` for others."""
    role, content = _c(role), _c(content)
    return F.when(role == "user", F.concat(F.lit("> user: "), content)).otherwise(F.concat(role, F.lit(": "), content))


def _first_codes(low: Column, table: dict[str, str], most: int) -> Column:
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table.items()]), lambda x: x.isNotNull())
    return F.array_sort(F.slice(F.array_distinct(found), 1, most))


def emotions(c: Column | str) -> Column:
    """Up to three emotion codes, the first declared, sorted."""
    return _first_codes(F.lower(_c(c)), L.EMOTIONS, 3)


def flags(c: Column | str) -> Column:
    """Up to five importance flags, the first declared, sorted."""
    return _first_codes(F.lower(_c(c)), L.FLAGS, 5)


def key_sentences(c: Column | str, n: int = 3) -> Column:
    """The best ``n`` sentences by decision words and length, earlier ones first in a tie, cut at 55 bytes."""
    parts = F.filter(F.transform(F.split(_c(c), r"[.!?\n]+"), trim_space), lambda s: F.octet_length(s) > 10)

    def scored(s, i):
        low, size = F.lower(s), F.octet_length(s)
        score = F.lit(0)
        for w in L.DECISION_WORDS:
            score = score + F.contains(low, F.lit(w)).cast("int") * 2
        score = score + (size < 80).cast("int") + (size < 40).cast("int") - (size > 150).cast("int") * 2
        return F.struct((-score).alias("score"), i.alias("i"), s.alias("s"))

    best = F.slice(F.array_sort(F.transform(parts, scored)), 1, n)
    return F.transform(best, lambda x: F.when(F.octet_length(x["s"]) > 55, F.concat(F.left(x["s"], F.lit(52)), F.lit("..."))).otherwise(x["s"]))


def topic_words(c: Column | str) -> Column:
    """Words of three or more letters with their weights: 1, and 2 more each for a capital start and a technical look."""
    found = F.regexp_extract_all(_c(c), F.lit("([a-zA-Z][a-zA-Z_-]{2,})"), F.lit(1))
    kept = F.filter(found, lambda w: ~is_one_of(F.lower(w), L.DIALECT_STOP_WORDS))
    return F.transform(kept, lambda w: F.struct(F.lower(w).alias("word"), (F.lit(1) + w.rlike("^[A-Z]").cast("int") * 2 + w.rlike("[_-]|.[A-Z]").cast("int") * 2).alias("weight")))


def topics(c: Column | str, n: int = 5) -> Column:
    """The ``n`` heaviest topic words, ties in order of the words: equal words become neighbours and are summed in one fold."""
    start = F.struct(F.array().cast("array<struct<weight:int,word:string>>").alias("done"), F.lit("").alias("word"), F.lit(0).alias("weight"))
    closed = lambda s: F.when(s["weight"] > 0, F.concat(s["done"], F.array(F.struct((-s["weight"]).alias("weight"), s["word"].alias("word"))))).otherwise(s["done"])

    def step(s, x):
        same = x["word"] == s["word"]
        return F.struct(F.when(same, s["done"]).otherwise(closed(s)).alias("done"), x["word"].alias("word"), (F.when(same, s["weight"]).otherwise(0) + x["weight"]).alias("weight"))

    sums = F.aggregate(F.array_sort(topic_words(c)), start, step, closed)
    return F.transform(F.slice(F.array_sort(sums), 1, n), lambda x: x["word"])


def capital_codes(c: Column | str) -> Column:
    """Up to three codes of capitalized words after the first, in order: the fallback without known entities."""
    words = F.slice(F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != ""), 2, 1 << 30)
    clean = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w.rlike("^[A-Z][a-z]+$") & ~is_one_of(F.lower(w), L.DIALECT_STOP_WORDS))
    return F.slice(F.array_distinct(F.transform(clean, lambda w: F.upper(F.left(w, F.lit(3))))), 1, 3)
