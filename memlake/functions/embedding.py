"""Embedding backends as Arrow batch functions, and the WordPiece tokenizer.

Defined results: null texts have no vector; texts without a word have the zero vector; another number of
vectors than texts is an error.
"""

from __future__ import annotations

import json
import unicodedata
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A batch of texts to one vector each."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word hashing into ``dims`` dimensions, unit length: deterministic and without a model."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dims] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class HttpEmbedder:
    """A server that takes ``{"model", "input"}`` and answers ``{"embeddings"}``."""

    def __init__(self, url: str, model: str):
        self.url, self.model = url, model

    def embed(self, texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"})) as r:
            vectors = json.load(r)["embeddings"]
        if len(vectors) != len(texts):
            raise ValueError("the server gave another number of vectors than texts")
        return np.asarray(vectors, float)


class OnnxEmbedder:
    """A transformer with WordPiece input, mean pooling over the mask and unit length."""

    def __init__(self, model_path: str, vocab_path: str, max_len: int = 256, batch: int = 8):
        self.model_path, self.vocab_path, self.max_len, self.batch, self.session = model_path, vocab_path, max_len, batch, None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session, self.tokenizer = onnxruntime.InferenceSession(self.model_path), WordPiece.load(self.vocab_path)
        out = []
        for i in range(0, len(texts), self.batch):
            ids, mask = self.tokenizer.encode(texts[i : i + self.batch], self.max_len)
            hidden = self.session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]
            out.append(mean_pool(hidden, mask))
        return np.concatenate(out) if out else np.zeros((0, 0))


def choose_embedder(*candidates: Embedder) -> Embedder | None:
    """The first backend that answers a probe; None if none does, and then texts go in without vectors."""
    for c in candidates:
        try:
            c.embed(["probe"])
            return c
        except Exception:  # noqa: BLE001, S112
            continue
    return None


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions, then unit length."""
    m = mask[..., None].astype(float)
    pooled = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    norms = np.linalg.norm(pooled, axis=1, keepdims=True)
    return pooled / np.where(norms > 0, norms, 1)


def embed_column(embedder: Embedder, text: Column) -> Column:
    """The vector of a text column; the backend is set up once per worker and called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = s.notna()
            vectors = embedder.embed(s[some].tolist())
            if len(vectors) != int(some.sum()):
                raise ValueError("another number of vectors than texts")
            rows = iter(np.asarray(vectors, np.float32).tolist())
            yield pd.Series([next(rows) if x else None for x in some], index=s.index, dtype=object)

    return run(text)


class WordPiece:
    """Greedy longest-match word pieces; a word with an unknown piece is one unknown token."""

    def __init__(self, vocab: dict[str, int], cls: str = "[CLS]", sep: str = "[SEP]", unk: str = "[UNK]"):
        self.vocab, self.cls, self.sep, self.unk = vocab, vocab[cls], vocab[sep], vocab[unk]

    @staticmethod
    def load(path: str) -> WordPiece:
        """A vocabulary file: the line number is the id."""
        with open(path, encoding="utf-8") as f:
            return WordPiece({line.rstrip("\n"): i for i, line in enumerate(f)})

    def pieces(self, text: str) -> list[int]:
        words, cur = [], ""
        for c in text.lower() + " ":
            alone = unicodedata.category(c)[0] in "PS"
            if c.isspace() or alone:
                words += [cur] if cur else []
                words += [c] if alone else []
                cur = ""
            else:
                cur += c
        return [i for w in words for i in self._word(w)]

    def _word(self, word: str) -> list[int]:
        out, start = [], 0
        while start < len(word):
            for end in range(len(word), start, -1):
                piece = ("##" if start else "") + word[start:end]
                if piece in self.vocab:
                    out.append(self.vocab[piece])
                    start = end
                    break
            else:
                return [self.unk]
        return out

    def encode(self, texts: list[str], max_len: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask), cut to ``max_len`` with the two special tokens and padded with zeros."""
        ids, mask = np.zeros((len(texts), max_len), np.int64), np.zeros((len(texts), max_len), np.int64)
        for i, t in enumerate(texts):
            row = [self.cls, *self.pieces(t)[: max_len - 2], self.sep]
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        return ids, mask
