"""Personal information inside free text: a linear-chain conditional random field over word shapes.

The labels are the beginnings and insides of five kinds of mention and the outside. The features of a word are
its shape (runs of letters and digits with their lengths, signs, case) and a small vocabulary (context
words, street words, a list of given names) in a window of three words to either side, and pairs of
neighbouring shapes. Most people, streets, hosts and projects of the training lines have invented names, so
that context and shape have to tell them apart. The field is trained by gradient descent on the exact likelihood, from the small labelled
table in ``pii_table``, in a few seconds on the driver; its weights have a fixed size.

Texts are tagged line by line. All lines of an Arrow batch are scored together; a line in which no word can
leave the outside label under the best transition has the outside path as its optimum and needs no
decoding; the others are decoded by Viterbi, one numpy step per word position for all lines at once.

Defined results: null and empty texts have no mention and stay as they are; repeated rows and repeated
mentions give one row each for a distinct (record, kind, text); lines of any length are tagged whole.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import pii_table as table

KINDS = {"n": "name", "e": "email", "p": "phone", "i": "idnum", "a": "address"}
LABELS = ["O"] + [f"{b}{k}" for k in KINDS for b in "BI"]
LABEL = {x: i for i, x in enumerate(LABELS)}
K = len(LABELS)
_INSIDE = np.array([x[0] == "I" for x in LABELS])
# Given names beyond those with short forms.
GIVEN = set("aisha amara bjarne ingrid kwame leila mateus odile omar priya thiago tomasz yuki odi odie maria anna john paul ana luis laura sara mark lena olga ivan sofia hugo".split())
GIVEN |= set(table.SHORT_FORMS) | {s for v in table.SHORT_FORMS.values() for s in v.split() if len(s) > 2}
_STREET = re.compile(r"(?i).{2,}(?:straße|strasse|str\.|straat|laan|weg|allee|gasse|platz|plein|gracht|kade|dijk)$")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_OBSCURED = re.compile(r"(?i)[\w.+-]+[\[(]at[\])][\w.\[\]()-]+")
_KEPT_DOT = {"rd.", "st.", "str.", "ave.", "av."}
_HEX = re.compile(r"(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,}(?:-\d+)?")
_HASH, _STOP = 1 << 16, 1 << 15
#: Share of the people of the labelled lines whose given name is on the list; the others have invented ones.
LISTED = 0.65
#: Share of the words that a training step takes for unknown, so that shapes and context learn to do without them.
FORGOTTEN = 0.12
# Sounds that invented words are made of.
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sch sh st t tr v w z".split()
VOWELS = "a e i o u ie ei ou".split()
CODAS = ["", "", "", "n", "r", "l", "s", "nd", "rt", "ck", "m", "ng"]


def _shape(token: str) -> str:
    tail = token[-1] if token[-1] in ",;:.!?" else ""
    core = token.strip(",;:.!?\"'«»“”„")
    if "=" in core and _MAIL.search(core):
        return "KEYMAIL" + tail
    if "@" in core:
        if core == "@":
            return "@"
        if core.startswith("git@"):
            return "GIT"
        return ("MAIL" if _MAIL.fullmatch(core) else "PACKAGE" if re.search(r"@\d", core) else "HANDLE") + tail
    if core.lower() in ("(at)", "[at]"):
        return "(at)"
    if _OBSCURED.fullmatch(core):
        return "OBSCURED" + tail
    if "/" in core and re.search(r"\w/\w", core):
        return "PATH" + tail
    if re.fullmatch(r"[A-Za-z][\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,}", core):
        return "DOMAIN" + tail
    if _HEX.fullmatch(core):
        return "HEX" + tail
    host = core.partition(":")[0].split(".")
    if len(host) == 4 and all(x.isdigit() and int(x) < 256 for x in host):
        return "HOST" + tail
    out = []
    for m in re.finditer(r"\d+|[^\W\d_]+|.", core):
        s = m[0]
        if s.isdigit():
            lead = s[0] if s[0] in "09" and len(s) > 1 and not any(x[-1:].isdigit() for x in out) else ""
            out.append(f"{lead}d{min(len(s), 12)}")
        elif s.isalpha():
            out.append((f"X{min(len(s), 4)}" if s.isupper() else "Xx" if s[0].isupper() and s[1:].islower() else "x" if s.islower() else "xX") + ("" if s.isascii() else "u"))
        else:
            out.append(s)
    return "".join(out) + tail


def _word(token: str) -> str:
    core = token.strip(",;:!?\"'«»“”„()[]")
    low = core.lower()
    bare = low.rstrip(".")
    if bare in GIVEN and not core[:1].islower():
        return "<given>"
    if _STREET.match(core) and core[:1].isupper():
        return "<street>"
    return low


class Tagger:
    """The trained field: tables of weights per feature, transitions, and the numbers of words and shapes."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        self.words, self.shapes = words, shapes
        self.window = [np.zeros((len(words) + 1, K), np.float32) for _ in range(7)] + [np.zeros((len(shapes) + 1, K), np.float32) for _ in range(7)]
        self.pairs = [np.zeros((_HASH, K), np.float32) for _ in range(5)]
        self.step = np.zeros((K, K), np.float32)
        self.memo: dict[str, int] = {}

    def code(self, token: str) -> int:
        c = self.memo.get(token)
        if c is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            c = self.memo[token] = self.words.get(_word(token), 0) << 16 | self.shapes.get(_shape(token), 0) | (_STOP if token[-1] in ";|" else 0)
        return c

    def features(self, codes: np.ndarray, line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(table, row of each word) of every feature; words of other lines count as row 0."""
        w, s = codes >> 16, codes & (_STOP - 1)
        n = len(codes)

        def shift(v, o):
            out = np.zeros(n, v.dtype)
            if abs(o) < n:
                if o > 0:
                    out[:-o] = np.where(line[:-o] == line[o:], v[o:], 0)
                elif o < 0:
                    out[-o:] = np.where(line[-o:] == line[:o], v[:o], 0)
                else:
                    out[:] = v
            return out

        ws, ss = {o: shift(w, o) for o in range(-3, 4)}, {o: shift(s, o) for o in range(-3, 4)}
        out = [(self.window[o + 3], ws[o]) for o in range(-3, 4)] + [(self.window[o + 10], ss[o]) for o in range(-3, 4)]
        mix = lambda a, b: (a * 7919 + b * 104729) % _HASH
        pairs = (mix(s, ss[1]), mix(ss[-1], s), mix(ws[-1], s), mix(ws[1], s), mix(ss[-1] * 31 + s, ss[1]))
        return out + list(zip(self.pairs, pairs))

    def emissions(self, codes: np.ndarray, line: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), K), np.float32)
        for weights, row in self.features(codes, line):
            out += weights[row]
        return out


def _forbidden() -> np.ndarray:
    """-inf where an inside label follows anything but its own kind."""
    out = np.zeros((K, K), np.float32)
    for j, y in enumerate(LABELS):
        if y[0] == "I":
            for i, x in enumerate(LABELS):
                if x[1:] != y[1:] or x == "O":
                    out[i, j] = -1e4
    return out


def _examples(rounds: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Token and label lists of lines: one to three sentences with values in their slots."""
    rnd = random.Random(seed)
    given = sorted(GIVEN)
    lines = lambda s: s.strip().splitlines()
    values = {"e": lines(table.EMAILS), "p": lines(table.PHONES), "i": lines(table.IDNUMS), "a": lines(table.ADDRESSES)}
    other = {"t": table.TICKETS, "d": table.DATES, "f": table.FILES, "v": table.VERSIONS, "c": table.COMMITS, "o": table.NUMBERS, "b": table.BUILDS}

    def invented() -> str:
        """A word that no list has: names of people, places, streets and projects must be told by their context."""
        word = "".join(rnd.choice(ONSETS) + rnd.choice(VOWELS) + rnd.choice(CODAS) for _ in range(rnd.choice((1, 2, 2, 3))))
        return word.title()

    def spelled(t: str) -> str:
        cases = {"s": str.lower, "S": str, "U": str.upper}
        return re.sub(r"\{([sSU])\}", lambda m: cases[m[1]](invented()), t)

    def digits(v: str, kind: str) -> str:
        """Other digits of the same look: the first of a run and zeros stay, but in most identity numbers."""
        if kind in "bv" or kind == "i" and v[0] != "9":
            return re.sub(r"\d", lambda m: rnd.choice("0123456789"), v)
        if kind == "p" and re.match(r"\(?[2-9]\d\d\D", v):
            v = re.sub(r"\d", lambda m: rnd.choice("23456789"), v, count=1)
        return re.sub(r"(?<=\d)[1-9]", lambda m: rnd.choice("123456789"), v)

    def name() -> str:
        g, s = rnd.choice(given).title() if rnd.random() < LISTED else invented(), invented()
        if rnd.random() < 0.04:
            return f"{g} {s}-{invented()}" if rnd.random() < 0.5 else f"{g} {rnd.choice(('van', 'de', 'von', 'da', 'di'))} {s}"
        r = rnd.random()
        return f"{g} {s}" if r < 0.5 else f"{s}, {g}" if r < 0.68 else f"{g} {rnd.choice('ABDEFGHKLMRSTVW')}. {s}" if r < 0.82 else f"{g[0]}. {s}" if r < 0.9 else rnd.choice(given).title()  # alone, an unknown word is no name

    def sentence(t: str):
        t = spelled(t)
        tokens, labels = [], []
        at = 0
        text, marks = "", []
        for m in re.finditer(r"\{(\w)\}", t):
            text += t[at : m.start()]
            k = m[1]
            v = name() if k == "n" else invented() if k == "x" else spelled(digits(rnd.choice(values[k]), k)) if k in values else spelled(digits(v, k) if (v := rnd.choice(other[k])) and k in "bv" else v)
            if k in "ent" and rnd.random() < 0.06:
                v = v.upper()
            if k in KINDS:
                marks.append((len(text), len(text) + len(v), k))
            text += v
            at = m.end()
        text += t[at:]
        for m in re.finditer(r"\S+", text):
            own = next(((a, k) for a, b, k in marks if m.start() < b and m.end() > a), None)
            tokens.append(m[0])
            labels.append(0 if own is None else LABEL[("B" if m.start() <= own[0] < m.end() else "I") + own[1]])
        if rnd.random() < 0.04 and not t.startswith("git") and "@" not in text:
            tokens = [x.upper() for x in tokens]
        return tokens, labels

    out = []
    pool = lines(table.SENTENCES)
    for _ in range(rounds):
        signatures = []
        for _ in range(30):
            sep = rnd.choice([" | ", " / ", "; ", ", tel/mail/id: "])
            signatures.append("-- {n}" + "".join(f"{sep}{{{k}}}" for k in rnd.sample("epia", rnd.randrange(1, 5))))
        for t in pool + signatures:
            tokens, labels = sentence(t)
            if rnd.random() < 0.5:
                a, b = sentence(rnd.choice(pool))
                tokens, labels = (tokens + a, labels + b) if rnd.random() < 0.5 else (a + tokens, b + labels)
            lead = rnd.choice([[], [], ["-"], [">", "user:"], ["assistant:"]])
            out.append((lead + tokens, [0] * len(lead) + labels))
    return out


@functools.cache
def trained(rounds: int = 10, epochs: int = 6, seed: int = 11) -> Tagger:
    """The field fitted to the labelled table: mini-batches of exact likelihood gradients with Adagrad."""
    data = _examples(rounds, seed)
    seen: dict[str, set] = {}
    for i, (tokens, labels) in enumerate(data):
        for x, y in zip(tokens, labels):
            if y == 0 or not any(c.isdigit() or c == "@" for c in x):
                seen.setdefault(_word(x), set()).add(i % 97)
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, s in seen.items() if len(s) >= 4))}  # invented words do not come back that often
    shapes = {s: i + 1 for i, s in enumerate(sorted({_shape(x) for t, _ in data for x in t}))}
    tagger = Tagger(words, shapes)
    rng = np.random.default_rng(seed)
    tables = tagger.window + tagger.pairs
    past = [np.full_like(t, 1e-4) for t in tables]
    step, step_past, ban = tagger.step, np.full((K, K), 1e-4, np.float32), _forbidden()
    first_ban = np.where([x[0] == "I" for x in LABELS], -1e4, 0).astype(np.float32)
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.3 * epoch)
        order = rng.permutation(len(data))
        for at in range(0, len(order), 64):
            some = [data[i] for i in order[at : at + 64]]
            counts = np.array([len(t) for t, _ in some])
            codes = np.array([tagger.code(x) for t, _ in some for x in t], np.int64)
            gold = np.array([y for _, l in some for y in l])
            codes = np.where(rng.random(len(codes)) < FORGOTTEN, codes & 0xFFFF, codes)
            line = np.repeat(np.arange(len(some)), counts)
            feats = tagger.features(codes, line)
            emit = sum(w[r] for w, r in feats)
            longest = counts.max()
            place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
            e = np.zeros((len(some), longest, K), np.float32)
            e[line, place] = emit
            trans = step + ban
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + first_ban
            live = np.arange(longest)[None] < counts[:, None]
            for t in range(1, longest):
                z = alpha[:, t - 1, :, None] + trans
                m = z.max(axis=1)
                alpha[:, t] = np.where(live[:, t, None], m + np.log(np.exp(z - m[:, None]).sum(axis=1)) + e[:, t], alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                z = trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
                m = z.max(axis=2)
                beta[:, t] = np.where(live[:, t + 1, None], m + np.log(np.exp(z - m[..., None]).sum(axis=2)), 0)
            last = alpha[:, -1]
            total = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
            grad = -np.exp(alpha + beta - total[:, None, None])[line, place]
            grad[np.arange(len(gold)), gold] += 1
            pair = np.zeros((K, K), np.float64)
            for t in range(1, longest):
                on = live[:, t]
                z = alpha[on, t - 1, :, None] + trans + (e[on, t] + beta[on, t])[:, None, :] - total[on, None, None]
                pair -= np.exp(z).sum(axis=0)
            inner = line[1:] == line[:-1]
            np.add.at(pair, (gold[:-1][inner], gold[1:][inner]), 1)
            grad /= 8
            for (w, r), p in zip(feats, past):
                rows, where = np.unique(r, return_inverse=True)
                g = np.zeros((len(rows), K), np.float32)
                np.add.at(g, where, grad)
                g -= 1e-3 * w[rows]
                p[rows] += g * g
                w[rows] += rate * 0.3 * g / np.sqrt(p[rows])
            g = (pair / 8).astype(np.float32)
            step_past += g * g
            step += rate * 0.3 * g / np.sqrt(step_past)
    for w in tagger.window:
        w[0] = 0 if w is not tagger.window[3] else w[0]
    tagger.step = step + ban
    tagger.memo.clear()
    return tagger


def _viterbi(emit: np.ndarray, starts: np.ndarray, counts: np.ndarray, step: np.ndarray) -> np.ndarray:
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0])
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")
    back = np.zeros((len(emit), K), np.int8)
    label = np.zeros(len(emit), np.int8)
    state = emit[starts] - 1e4 * _INSIDE.astype(np.float32)
    for t in range(1, longest):
        m = alive[t]
        at = starts[:m] + t
        z = state[:m, :, None] + step
        back[at] = z.argmax(axis=1)
        state[:m] = z.max(axis=1) + emit[at]
    last = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        label[at] = last[:m]
        if t:
            last[:m] = back[at, last[:m]]
    return label


def _tag(lines: list[list[str]], tagger: Tagger):
    """(line, first, end, kind) of every mention."""
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    code = tagger.code
    codes = np.fromiter((code(x) for t in lines for x in t), np.int64, int(counts.sum()))
    if not len(codes):
        return
    line = np.repeat(np.arange(len(lines)), counts)
    emit = tagger.emissions(codes, line)
    after = np.flatnonzero((codes[:-1] & _STOP > 0) & (line[1:] == line[:-1])) + 1
    emit[np.ix_(after, np.flatnonzero(_INSIDE))] -= 1e4  # no mention goes on after a semicolon or a bar
    gain = emit[:, 1:].max(axis=1) - emit[:, 0]
    extra = max(0.0, float((tagger.step - tagger.step[0, 0]).max()))
    open_ = np.zeros(len(lines), bool)
    # a mention of L words takes L + 1 steps that are not from outside to outside, so at most 2 a word
    open_[line[gain + 2 * extra > 0]] = True
    if not open_.any():
        return
    keep = open_[line]
    n = counts[open_]
    starts = np.cumsum(n) - n
    label = _viterbi(emit[keep], starts, n, tagger.step)
    own = line[keep]
    pos = np.arange(len(label)) - np.repeat(starts, n)
    begin = np.flatnonzero((label > 0) & (label % 2 == 1))
    for b in begin.tolist():
        e = b + 1
        while e < len(label) and own[e] == own[b] and label[e] == label[b] + 1:
            e += 1
        yield int(own[b]), int(pos[b]), int(pos[b]) + e - b, LABELS[label[b]][1]


def _bounds(text: str, kind: str) -> tuple[int, int]:
    """Where the mention itself stands in the white-space tokens it was found in."""
    a, b = 0, len(text)
    if kind == "e":
        m = _MAIL.search(text) or re.search(r"[\w.+-]+ ?(?:[\[(](?:at|AT)[\])]|@) ?[\w-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\w-]+)+", text)
        return m.span() if m else (a, b)
    while a < b and (text[a] in "[{\"'«„“,;:" or text[a] == "(" and not (kind == "p" and ")" in text)):
        a += 1
    while b > a and (text[b - 1] in ",;:!?]}\"'»”“" or text[b - 1] == ")" and "(" not in text[a:b] or text[b - 1] == "." and not (kind == "a" and text[a:b].split()[-1].lower() in _KEPT_DOT)):
        b -= 1
    return a, b


_WELL_FORMED = {"e": re.compile(r"(?i)@|[\[(]at[\])]"), "p": re.compile(r"(?:\D*\d){7}"), "i": re.compile(r"(?:.*\d){4}"), "a": re.compile(r"(?s)(?=.*\d).*[A-ZÄÖÜА-Я]|пр\.|ул"), "n": re.compile(r"^[^\d_=]*[^\W\d_]{2}[^\d_=]*$")}


def mentions(texts: list[str | None], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Of every text, the (start, end, kind) of its mentions."""
    rows, owner, offset = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for s in (t or "").split("\n"):
            if s and not s.isspace():
                rows.append(s)
                owner.append(i)
                offset.append(at)
            at += len(s) + 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    spans: dict[int, list] = {}
    for row, first, end, kind in _tag([s.split() for s in rows], tagger):
        if row not in spans:
            spans = {row: [m.span() for m in re.finditer(r"\S+", rows[row])]}
        a, b = spans[row][first][0], spans[row][end - 1][1]
        x, y = _bounds(rows[row][a:b], kind)
        if _WELL_FORMED[kind].search(rows[row][a + x : a + y]):
            out[owner[row]].append((offset[row] + a + x, offset[row] + a + y, KINDS[kind]))
    return out


def _found(tagger: Tagger):
    def go(batches):
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            rows = {(k, kind, t[x:y]) for k, t, m in zip(keys, texts, mentions(texts, tagger)) for x, y, kind in m}
            k, kind, text = zip(*sorted(rows)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(kind, pa.string()), pa.array(text, pa.string())], names=["rec_key", "kind", "pii"])

    return go


def _redacted(tagger: Tagger):
    def go(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out, n = [], []
            for t, found in zip(texts, mentions(texts, tagger)):
                at, made = 0, []
                for x, y, kind in found:
                    made += (t[at:x], f"[{kind.upper()}]")
                    at = y
                out.append(t if t is None else "".join(made) + t[at:])
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["rec_key", "text", "n_mentions"])

    return go


def find_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, kind, pii): each different mention of each record, as it stands in the text."""
    rows = df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text")).where(F.col("rec_key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(_found(trained()), "rec_key string, kind string, pii string").distinct()


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, text, n_mentions): every row with placeholders such as ``[EMAIL]`` for its mentions."""
    rows = df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text"))
    return rows.mapInArrow(_redacted(trained()), "rec_key string, text string, n_mentions int")
