"""The language of documents and of mixed-language segments.

Word scores are log probabilities of words per language, counted in documents whose language is known. Of a
text, every word gets a score per language: the script of its letters first narrows the candidates (a word in
Cyrillic letters can only be in a Cyrillic language, one in Latin letters in none of them), then its counts decide.
A word in small letters that was never seen is scored by its character n-grams, within ``GUESS`` of the best;
capitalized unknown words, names, identifiers, paths and numbers say nothing. Viterbi over the words, with a penalty
for each switch that is lower at the start of a sentence, labels spans.

``language_segments`` gives the spans: neighbouring words and sentences of one language are one segment, also
within a sentence. ``document_languages`` counts sentences: one has the language of most of its words, and is
whole if ``MIN_WORDS`` of them are known words; a text without a whole sentence has the language of its shorter
sentences, with a confidence lowered in proportion.

All documents of an Arrow batch are decoded together, one numpy step per word position.

Defined results: null and empty texts, and texts without a word that carries a score, have no language
and no segment; ties go to the language that comes first in ``LANGUAGES``; repeated rows are labelled alike; any length
of text is decoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru")
CYRILLIC = np.array([x == "ru" for x in LANGUAGES])
SWITCH, SWITCH_AT_SENTENCE, MIN_WORDS = 9.0, 2.0, 3
#: Bound on the labelled documents that the word scores are counted in.
FIT_ROWS = 8000
FORBIDDEN = -30.0
#: Length of the character n-grams of unseen words, and how far they can set languages apart.
NGRAM, GUESS = 3, 2.5

# Codes and names of the languages as people write them.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels английский",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco duits немецкий",
    "fr": "fr fra fre french français francais französisch francés frances francês francese frans французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spagnolo spaans испанский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский",
    "it": "it ita italian italiano italienisch italien italiaans итальянский",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés holandés holandês olandese flemish vlaams нидерландский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}


def language_code(label: Column) -> Column:
    """The two-letter code of a written language label; null if it names none of the languages."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}]+)*$", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    return F.element_at(table, bare)


_EDGE = "()[]{}\"'«»“”„‘’¿¡,;:.!?…–—-*#|>`=<&/"
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…]+[\"'»”’)\]]*$")
_LINE = "\x01"


# Tokens that say who speaks, and abbreviations that end no sentence.
_ROLES = {"user:", "assistant:", "system:", "human:", "USER:", "ASSISTANT:", "SYSTEM:"}
_ABBREVIATIONS = {"no.", "nr.", "av.", "rd.", "st.", "ave.", "str.", "tel.", "ext.", "dr.", "prof."}


def _tokens(text: str) -> list[str]:
    """White-space tokens, with a mark at each line end; a text all in capitals is read in small letters."""
    if text.isupper():
        text = text.lower()
    return text.replace("\n", f" {_LINE} ").split()


def _word(token: str) -> str | None:
    """The word of a token in lower case; None for identifiers, paths, numbers and marks."""
    core = token.strip(_EDGE)
    return core.lower() if core and _PLAIN.fullmatch(core) and not core[1:].lower() != core[1:] else None


def _lower_words(batches):
    for b in batches:
        words, langs = [], []
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = {w for x in _tokens(t) if x[:1].islower() and (w := _word(x))}
            words += seen
            langs += [lang] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(langs, pa.string())], names=["word", "lang"])


def fit_word_scores(labelled: DataFrame, text: str, lang: str, key: str, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Word to its log probability per language, from at most about ``fit_rows`` labelled rows picked by a hash."""
    known = labelled.where(F.col(lang).isin(*LANGUAGES) & F.col(text).isNotNull())
    every = max(1, -(-known.count() // fit_rows))
    rows = known.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(text, lang)
    counts = rows.mapInArrow(_lower_words, "word string, lang string").groupBy("word", "lang").count()
    counts = counts.toPandas()  # the vocabulary of at most fit_rows documents
    if not len(counts):
        return {}
    table = counts.pivot_table(index="word", columns="lang", values="count", fill_value=0).reindex(columns=list(LANGUAGES), fill_value=0)
    table = table[table.sum(axis=1) >= 3]
    docs = rows.groupBy(lang).count().toPandas().set_index(lang)["count"].reindex(list(LANGUAGES), fill_value=0)
    p = (table.to_numpy(float) + 0.02) / (docs.to_numpy(float) + 1.0)
    scores = np.log(p) - np.log(p).max(axis=1, keepdims=True)
    return dict(zip(table.index, np.maximum(scores, -6.0).astype(np.float32)))


def _is_cyrillic(word: str) -> bool:
    return "Ѐ" <= word[0] <= "ӿ"


def _ngrams(word: str) -> list[str]:
    p = f" {word} "
    return [p[i : i + NGRAM] for i in range(len(p) - NGRAM + 1)]


class _Scorer:
    """Token to the row of its score; row 0 is no language, then come the known words, then unseen ones."""

    def __init__(self, scores: dict[str, np.ndarray]):
        k = len(LANGUAGES)
        self.index = {w: i + 1 for i, w in enumerate(scores)}
        self.known = len(scores) + 1
        self.rows = np.zeros((2 * self.known + 1024, k), np.float32)
        share: dict[str, np.ndarray] = {}
        for w, i in self.index.items():
            self.rows[i] = scores[w] + self.script(w)
            for g in _ngrams(w):
                share[g] = share.get(g, 0) + np.exp(scores[w])
        total = sum(share.values()) if share else np.ones(k)
        self.share = {g: np.log((v + 0.1) / (total + 0.1 * len(share))) for g, v in share.items()}
        self.unseen: dict[str, int] = {}
        self.memo: dict[str, int] = {}

    @staticmethod
    def script(word: str) -> np.ndarray:
        """The script narrows the candidates: languages of another script are out of the question."""
        return np.where(CYRILLIC == _is_cyrillic(word), 0, FORBIDDEN).astype(np.float32)

    def guess(self, word: str) -> int:
        """The row of an unseen word: 0 if its n-grams say nothing, else its score by n-grams."""
        row = self.unseen.get(word)
        if row is None:
            seen = [self.share[g] for g in _ngrams(word) if g in self.share]
            if not seen and not _is_cyrillic(word):
                return 0
            score = np.sum(seen, axis=0) if seen else np.zeros(len(LANGUAGES))
            score = np.maximum(score - score.max(), -GUESS) + self.script(word)
            if len(self.unseen) >= 200_000:
                self.unseen.clear()
                self.memo.clear()
            row = self.unseen[word] = self.known + len(self.unseen)
            if row >= len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[row] = score - score.max()
        return row

    def code(self, token: str) -> int:
        """Row of the score, shifted left by one; the last bit says that a sentence ends here."""
        c = self.memo.get(token)
        if c is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            w = None if token in _ROLES else _word(token)
            row = 0
            if w:
                row = self.index.get(w) or (self.guess(w) if _is_cyrillic(w) or token.strip(_EDGE)[:1].islower() and len(w) > 2 else 0)
            c = self.memo[token] = row * 2 + bool(token == _LINE or _ENDS.search(token) and token.lower() not in _ABBREVIATIONS and (len(token) != 2 or not token[0].isupper()))
        return c


def _viterbi(score: np.ndarray, opens: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The label of every word; texts one after the other, ``opens`` where a sentence begins."""
    n_texts, k = len(counts), score.shape[1]
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0]) if n_texts else 0
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")
    back = np.empty((len(score), k), np.int8)
    label = np.zeros(len(score), np.int8)
    state = np.zeros((n_texts, k), np.float32)
    own = np.arange(k, dtype=np.int8)
    for t in range(longest):
        m = alive[t]
        at = starts[:m] + t
        now = state[:m]
        if t:
            best = now.argmax(axis=1).astype(np.int8)
            jump = now[np.arange(m), best] - np.where(opens[at], np.float32(SWITCH_AT_SENTENCE), np.float32(SWITCH))
            stay = now >= jump[:, None]
            back[at] = np.where(stay, own, best[:, None])
            now = np.maximum(now, jump[:, None])
        state[:m] = now + score[at]
    last = state.argmax(axis=1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        label[at] = last[:m]
        if t:
            last[:m] = back[at, last[:m]]
    return label


def _decode(texts: list[str], scorer: _Scorer) -> dict[str, np.ndarray] | None:
    """Of every word that carries a score: its text, token, sentence, label, scores and whether it is a known word."""
    lists = [_tokens(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    code = scorer.code
    codes = np.fromiter((code(x) for t in lists for x in t), np.int64, int(counts.sum()))
    rows, ends = codes >> 1, (codes & 1).astype(bool)
    live = np.flatnonzero(rows > 0)
    if not len(live):
        return None
    starts = np.cumsum(counts) - counts
    opens = np.empty(len(codes), bool)
    opens[0] = True
    opens[1:] = ends[:-1]
    opens[starts[counts > 0]] = True
    text = np.repeat(np.arange(len(lists)), counts)
    sentence = np.cumsum(opens) - 1
    score, own, of = scorer.rows[rows[live]], sentence[live], text[live]
    n = np.bincount(of, minlength=len(lists))
    first = np.ones(len(live), bool)
    first[1:] = own[1:] != own[:-1]
    label = _viterbi(score, first, np.cumsum(n) - n, n)
    begin = np.flatnonzero(opens) - starts[text[opens]]
    return {"text": of, "token": live - starts[of], "sentence": own, "first": first, "begin": begin[own], "label": label, "score": score, "known": rows[live] < scorer.known, "size": counts}


def _sure(score: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The probability of the language of each run of words that begins at ``at``, by the scores of its words."""
    total = np.add.reduceat(score, at, axis=0)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p[np.arange(len(at)), lang] / p.sum(axis=1)


def _segments(scores: dict):
    """Runs of words of one label. A run that begins with a sentence takes the whole beginning of the sentence."""

    def go(batches):
        scorer = _Scorer(scores)
        for b in batches:
            d = _decode([t or "" for t in b.column(1).to_pylist()], scorer)
            if d is None:
                continue
            of, label = d["text"], d["label"]
            at = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]) | (label[1:] != label[:-1])) + 1])
            n = np.diff(np.append(at, len(of)))
            lang, text = label[at], of[at]
            first = np.where(d["first"][at], d["begin"][at], d["token"][at])
            end = np.append(first[1:], 0)
            last = np.append(text[1:] != text[:-1], True)
            end[last] = d["size"][text[last]]
            known = np.add.reduceat(d["known"].astype(int), at)
            sure = _sure(d["score"], at, lang) * np.minimum(1.0, (known + 0.5 * (n - known)) / MIN_WORDS)
            names = ["id", "first", "end", "lang", "words", "confidence"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.array(LANGUAGES)[lang]), pa.array(n.astype(np.int32)), pa.array(sure)], names=names)

    return go


def _document_languages(scores: dict):
    def go(batches):
        scorer = _Scorer(scores)
        k = len(LANGUAGES)
        for b in batches:
            d = _decode([t or "" for t in b.column(1).to_pylist()], scorer)
            if d is None:
                continue
            at = np.flatnonzero(d["first"])
            ordinal = np.cumsum(d["first"]) - 1
            votes = np.zeros((len(at), k), np.int32)
            np.add.at(votes, (ordinal, d["label"]), 1)
            lang, text, n = votes.argmax(axis=1), d["text"][at], votes.sum(axis=1)
            known = np.bincount(ordinal, weights=d["known"], minlength=len(at))
            whole = known >= MIN_WORDS
            some = np.bincount(text, weights=whole, minlength=len(b)) > 0
            keep = whole | ~some[text]
            sure = _sure(d["score"], at, lang) * votes.max(axis=1) / n * np.minimum(1.0, (known + 0.5 * (n - known)) / MIN_WORDS)
            key, where, count = np.unique(text[keep] * k + lang[keep], return_inverse=True, return_counts=True)
            mean = np.bincount(where, weights=sure[keep], minlength=len(key)) / count
            full = np.bincount(where, weights=whole[keep], minlength=len(key))
            names = ["id", "lang", "sentences", "whole", "confidence"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(key // k)), pa.array(np.array(LANGUAGES)[key % k]), pa.array(count.astype(np.int32)), pa.array(full.astype(np.int32)), pa.array(mean)], names=names)

    return go


def _input(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()), df.schema[id_column].dataType.simpleString()


def document_languages(df: DataFrame, id_column: str, text: str, scores: dict) -> DataFrame:
    """(id, lang, sentences, whole, confidence): each language of each row with its sentences, and how many are whole."""
    rows, kind = _input(df, id_column, text)
    return rows.mapInArrow(_document_languages(scores), f"id {kind}, lang string, sentences int, whole int, confidence double")


def language_segments(df: DataFrame, id_column: str, text: str, scores: dict) -> DataFrame:
    """(id, first, end, lang, words, confidence): each stretch of one language, by white-space token positions."""
    rows, kind = _input(df, id_column, text)
    return rows.mapInArrow(_segments(scores), f"id {kind}, first int, end int, lang string, words int, confidence double")
