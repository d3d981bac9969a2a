"""The Porter stemmer (1980), for words of the vocabulary."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules of steps 2 to 4.
STEP_2 = "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log"
STEP_3 = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_2, _3 = ([tuple(r.split(">")) for r in s.split(" ")] for s in (STEP_2, STEP_3))


def _shape(w: str) -> str:
    """The word in c and v; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or x == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules, least: int) -> str:
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(old):
            stem = w[: -len(old)]
            return stem + new if _measure(stem) > least else w
    return w


@functools.lru_cache(1 << 17)
def stem(w: str) -> str:
    """The stem of a lower-case ASCII word of three letters or more; other words stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _2, 0), _3, 0)
    for suffix in sorted(STEP_4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Arrays of tokens to arrays of stems."""
    return tokens.map(lambda t: None if t is None else [stem(x) for x in t])


def stemmed_tokens(c):
    """Folded tokens as stems: the analyzer of the full-text index."""
    from memlake.functions import text as X

    return stemmed(X.tokens(c))
