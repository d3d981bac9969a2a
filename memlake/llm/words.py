"""Words and hashed word shingles of whole batches of texts, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from memlake.llm.canonical import CYRILLIC, GREEK, canonical

_ASCII_BREAKS = {i: " " for i in range(128) if not chr(i).isalnum()}
_WORD = re.compile(r"[^\W_]+")
#: After case folding, a letter whose capital looks like a Latin one is that Latin letter in small.
_SMALL = {ord(k.casefold()): v.casefold() for t in (GREEK, CYRILLIC) for k, v in t.items() if k.isupper() and len(k.casefold()) == 1}
_SMALL_SET = frozenset(map(chr, _SMALL))


def words(text: str) -> list[str]:
    """Runs of letters and digits of the canonical form, without regard to case."""
    t = canonical(text).casefold()
    if t.isascii():
        return t.translate(_ASCII_BREAKS).split()
    if not _SMALL_SET.isdisjoint(t):
        t = t.translate(_SMALL)
    return _WORD.findall(t)


class _Ids(dict):
    """Word to 64-bit hash, kept while it is small enough."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_ids = _Ids()


def hashes(tokens: list[str]) -> np.ndarray:
    """The 64-bit hash of each token."""
    return np.fromiter(map(_ids.__getitem__, tokens), np.uint64, len(tokens))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` token hashes, by its first token."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : i + n] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
    return out.view(np.int64)


def batch_shingles(token_lists: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the shingle hashes, for each the index of its text, and its position in that text."""
    counts = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
    flat = hashes([w for t in token_lists for w in t])
    h = shingles(flat, size)
    text = np.repeat(np.arange(len(token_lists)), counts)[: len(h)]
    starts = np.cumsum(counts) - counts
    pos = np.arange(len(h)) - starts[text]
    whole = pos + size <= counts[text]
    return h[whole], text[whole], pos[whole]
