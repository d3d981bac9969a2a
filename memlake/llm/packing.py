"""Filling fixed-capacity containers with texts, measured in tokens of a public tokenizer.

Lexical retrieval packing: documents are range-sorted by language and place into shards of at most
``SHARD_DOCS`` items. A shard has a BM25 inverted index whose document frequencies and mean length are counted
over all documents. The longest unused item of the shard is the seed of a window; the index returns its
unused neighbours by score, and they fill the window greedily, each as long as it fits; the last ``CLOSE`` of the
capacity goes to the unused item that fills most of it. Texts longer than a container fill containers of
their own, and only their last piece is an item like the others.

Token counts are exact: byte-pair merges never cross the boundary before a single space that follows a
non-space, so a text's count is the sum over its space-separated parts, which are counted once and kept; a
text with other runs of spaces is counted as a whole.

Defined results: null texts are left out, empty ones are items of 0 tokens; repeated rows with the same id
are items each; every item is in exactly one container and none is cut unless it exceeds the capacity.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import written

CAPACITY, SHARD_DOCS, BUCKETS = 2048, 2048, 1 << 17
K1, B = 1.2, 0.75
#: Share of a container that is filled by size instead of by neighbourhood, once no more than that is left.
CLOSE = 1 / 16


def default_tokenizer() -> str:
    """The rank file of the installed byte-level BPE of 50,256 tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Parts(dict):
    """Space-separated part to its tokens with its leading space; -1 where that is not their number in the text."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = _encoding(path).encode_ordinary

    def __missing__(self, part: str) -> int:
        if len(self) > 600_000:
            self.clear()
        code = len(self.encode(" " + part)) if part and not part[0].isspace() and not part[-1].isspace() else -1
        self[part] = code
        return code


class _Terms(dict):
    """White-space token to the bucket of its word; -1 if it has none."""

    def __missing__(self, token: str) -> int:
        if len(self) > 600_000:
            self.clear()
        word = token.strip(".,;:!?()[]{}<>\"'«»“”„-–—*#|`").lower()
        code = self[token] = xxhash.xxh32_intdigest(word) % BUCKETS if word else -1
        return code


def _measure(path: str):
    """(doc columns, n_tokens, n_words, terms, tfs) of every text; terms and counts as packed integers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(path)
        encode = parts.encode
        get, term_of = parts.__getitem__, _Terms().__getitem__
        for b in batches:
            texts = b.column("text").to_pylist()
            lists = [t.split(" ") for t in texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            codes = np.fromiter((get(x) for p in lists for x in p), np.int64, int(counts.sum()))
            starts = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(lists)), counts)
            odd = np.bincount(doc[codes < 0], minlength=len(lists)) > 0
            codes = np.maximum(codes, 0)
            tokens = np.add.reduceat(codes, starts) if len(codes) else np.zeros(0, np.int64)
            for i, t in enumerate(texts):
                if odd[i]:
                    tokens[i] = len(encode(t))
                else:  # the first part has no space before it
                    tokens[i] += len(encode(lists[i][0])) - codes[starts[i]]
            words = [t.split() for t in texts]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            term = np.fromiter((term_of(x) for p in words for x in p), np.int64, int(counts.sum()))
            owner = np.repeat(np.arange(len(words)), counts)[term >= 0]
            key, tf = np.unique(owner * BUCKETS + term[term >= 0], return_counts=True)
            n = np.bincount(key // BUCKETS, minlength=len(lists))
            terms, tf = (key % BUCKETS).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()
            ends = np.cumsum(n)
            cut = list(zip((ends - n).tolist(), ends.tolist()))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array(tokens.astype(np.int64)), pa.array(counts.astype(np.int32)), pa.array([terms[4 * x : 4 * y] for x, y in cut], pa.binary()), pa.array([tf[4 * x : 4 * y] for x, y in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "n_tokens", "n_words", "terms", "tfs"])

    return go


def _frequencies(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column(0):
            total[np.frombuffer(x.as_buffer(), np.int32)] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "df"])


def pack_shard(sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of item numbers: each seed with its BM25 neighbours, as many as fit.

    ``owner``, ``term``, ``weight`` are the postings of the shard; ``sizes`` are at most ``capacity``.
    """
    m = len(sizes)
    order = np.argsort(term, kind="stable")
    p_owner, p_weight, p_term = owner[order], weight[order], term[order]
    list_start = np.searchsorted(p_term, term, side="left")  # of each posting, its term's list
    list_len = np.searchsorted(p_term, term, side="right") - list_start
    own_start = np.searchsorted(owner, np.arange(m + 1))
    unused = np.ones(m, bool)
    left = m
    windows = []
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        left -= 1
        window, room = [seed], capacity - int(sizes[seed])
        if left and room > 0:
            fits = np.flatnonzero(unused & (sizes <= room))
            if len(fits):
                a, b = own_start[seed], own_start[seed + 1]
                lens = list_len[a:b]
                at = np.repeat(list_start[a:b] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
                score = np.bincount(p_owner[at], weights=p_weight[at], minlength=m)
                ranked = fits[np.argsort(-score[fits], kind="stable")]
                size = sizes[ranked]
                while len(ranked):
                    # the best neighbour; the last CLOSE of the capacity is closed by the one that fills most of it
                    pick = 0 if room > capacity * CLOSE else int(np.argmax(size))
                    window.append(int(ranked[pick]))
                    unused[ranked[pick]] = False
                    left -= 1
                    room -= int(size[pick])
                    keep = size <= room
                    keep[pick] = False
                    ranked, size = ranked[keep], size[keep]
        windows.append(window)
    return windows


def _pack(capacity: int, idf: np.ndarray, mean_words: float):
    names = ["container", "slot", "doc_id", "piece", "n_pieces", "token_from", "n_tokens"]

    def shard(t: pa.Table, pid: int, seq: int):
        n = t.column("n_tokens").to_numpy().astype(np.int64)
        words = t.column("n_words").to_numpy()
        pieces = np.maximum(-(-n // capacity), 1)
        last = n - (pieces - 1) * capacity
        terms = [np.frombuffer(x.as_buffer(), np.int32) for c in t.column("terms").chunks for x in c]
        tfs = [np.frombuffer(x.as_buffer(), np.int32) for c in t.column("tfs").chunks for x in c]
        count = np.fromiter(map(len, terms), np.int64, len(terms))
        owner = np.repeat(np.arange(len(n)), count)
        term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[owner] / mean_words))
        rows = {k: [] for k in names}
        ids = t.column("doc_id")

        def put(container, slot, item, piece, size):
            rows["container"].append(container)
            rows["slot"].append(slot)
            rows["doc_id"].append(item)
            rows["piece"].append(piece)
            rows["n_pieces"].append(int(pieces[item]))
            rows["token_from"].append(piece * capacity)
            rows["n_tokens"].append(size)

        base = pid << 32
        for item in np.flatnonzero(pieces > 1).tolist():
            for piece in range(int(pieces[item]) - 1):
                put(base + seq, 0, item, piece, capacity)
                seq += 1
        for window in pack_shard(last, owner, term, weight, capacity):
            for slot, item in enumerate(window):
                put(base + seq, slot, item, int(pieces[item]) - 1, int(last[item]))
            seq += 1
        cols = [pa.array(rows["container"], pa.int64()), pa.array(rows["slot"], pa.int32()), ids.take(pa.array(rows["doc_id"], pa.int64())).combine_chunks()]
        cols += [pa.array(rows[k], pa.int32()) for k in ("piece", "n_pieces")] + [pa.array(rows[k], pa.int64()) for k in ("token_from", "n_tokens")]
        if isinstance(cols[2], pa.ChunkedArray):
            cols[2] = pa.concat_arrays(cols[2].chunks)
        return pa.RecordBatch.from_arrays(cols, names=names), seq

    def go(batches):
        pid, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, SHARD_DOCS - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == SHARD_DOCS:
                    out, seq = shard(pa.Table.from_batches(held), pid, seq)
                    held, n = [], 0
                    yield out
        if n:
            yield shard(pa.Table.from_batches(held), pid, seq)[0]

    return go


def pack_documents(df: DataFrame, doc_id: str, text: str, near: list[str], capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(container, slot, doc_id, piece, n_pieces, token_from, n_tokens): the container of every item.

    ``near`` names the columns by which neighbouring documents are brought into one shard.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    near_kinds = [(f"near_{i}", df.schema[c].dataType.simpleString()) for i, c in enumerate(near)]
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"near_{i}") for i, c in enumerate(near)], F.col(text).alias("text"))
    schema = ", ".join([f"doc_id {kind}", *[f"{a} {b}" for a, b in near_kinds], "n_tokens long, n_words int, terms binary, tfs binary"])
    items = written(rows.mapInArrow(_measure(tokenizer or default_tokenizer()), schema))
    stats = items.agg(F.count("*").alias("n"), F.avg("n_words").alias("words")).first()
    df_rows = items.select("terms").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # at most BUCKETS rows
    frequency = np.zeros(BUCKETS)
    frequency[df_rows.bucket.to_numpy(np.int64)] = df_rows.df.to_numpy(float)
    idf = np.log1p((stats["n"] - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    parts = max(1, -(-stats["n"] // SHARD_DOCS))  # a shard is a task
    order = [a for a, _ in near_kinds] + ["doc_id"]
    shards = items.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return shards.select("doc_id", "n_tokens", "n_words", "terms", "tfs").mapInArrow(
        _pack(capacity, idf, float(stats["words"] or 1.0)), f"container long, slot int, doc_id {kind}, piece int, n_pieces int, token_from long, n_tokens long"
    )
