"""Evaluation texts leaking into a corpus.

Of every item, the windows of ``min_words`` consecutive passage words and the whole question are looked for.
A window is the set of its positioned 5-word shingles, and a document can only hold it if it holds every
one of them. So one pass over the corpus keeps the (document, position) of the items' shingles; the shingles
are ordered by rarity over the whole corpus; each window joins the documents on the shingle that comes first
in that order, its necessary prefix; the position of the hit must leave room for the whole window before and
after; and each survivor is verified shingle by shingle over the window.

The items' shingles go to the executors only while they are below ``BROADCAST_BYTES``; beyond that the
corpus shingles are shuffled and joined.

Defined results: null or empty texts and items hold and leak nothing; a passage of fewer than ``min_words``
words can't leak, a question of any length of one word or more can; repeated documents are reported one by
one under their ids, repeated items once; no document or item is cut or skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.words import batch_shingles, hashes, shingles, words
from memlake.runtime import BROADCAST_BYTES, written

SHINGLE = 5
#: Corpus hits of one shingle that a task of the prefix join takes; more are salted, none is left out.
MAX_HITS = 1 << 16


def _item_windows(item_id: str, size: int, min_words: int):
    """Rows of (item, part, window, length, offset, h, k): the positioned shingles of every window."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("item", "part", "win", "len", "off", "h", "k")}
            for item, passage, question in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for part, text in ((0, passage), (1, question)):
                    w = words(text) if text else []
                    n = min_words if part == 0 else len(w)
                    if not n or len(w) < n:
                        continue
                    k = min(size, n)
                    h = shingles(hashes(w), k)
                    for start in range(len(w) - n + 1):
                        for off in range(n - k + 1):
                            for key, v in zip(out, (item, part, start, n, off, int(h[start + off]), k)):
                                out[key].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))})

    return run


def _corpus_hits(sizes: list[int], keep: dict[int, np.ndarray] | None):
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [words(t) if t else [] for t in texts]
            counts = np.fromiter(map(len, lists), np.int32, len(lists))
            for k in sizes:
                h, text, pos = batch_shingles(lists, k)
                if keep is not None:
                    at = np.searchsorted(keep[k], h)
                    at[at == len(keep[k])] = 0
                    hit = keep[k][at] == h
                    h, text, pos = h[hit], text[hit], pos[hit]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(h), pa.array(np.full(len(h), k, np.int32)), pa.array(counts[text])], names=["doc", "pos", "h", "k", "n_words"]
                )

    return run


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, question: str, min_words: int = 13) -> DataFrame:
    """(doc, item, n_windows): the documents that hold an item, with the number of its windows found."""
    id_type, item_type = corpus.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    windows = written(
        items.select(item_id, passage, question)
        .where(F.col(item_id).isNotNull())
        .distinct()
        .mapInArrow(_item_windows(item_id, SHINGLE, min_words), f"item {item_type}, part int, win int, len int, off int, h long, k int")
    )
    wanted = windows.select("k", "h").distinct()
    stats = wanted.groupBy("k").count().collect()  # one row per shingle length, at most SHINGLE
    sizes = [r["k"] for r in stats]
    small = 8 * sum(r["count"] for r in stats) <= BROADCAST_BYTES
    keep = None
    if small:
        rows = wanted.toPandas()
        keep = {k: np.sort(rows.h[rows.k == k].to_numpy(np.int64)) for k in sizes}
    docs = corpus.select(doc_id, text).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    hits = docs.mapInArrow(_corpus_hits(sizes, keep), f"doc {id_type}, pos int, h long, k int, n_words int")
    if not small:
        hits = hits.join(wanted, ["k", "h"], "left_semi")
    hits = written(hits)

    rarity = written(hits.groupBy("k", "h").agg(F.countDistinct("doc").alias("df"), F.ceil(F.count("*") / MAX_HITS).alias("salts")))
    ranked = windows.join(rarity, ["k", "h"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    one = Window.partitionBy("item", "part", "win").orderBy("df", "h", "off")
    prefix = ranked.withColumn("rank", F.row_number().over(one)).where((F.col("rank") == 1) & (F.col("df") > 0))
    prefix = prefix.select("item", "part", "win", "len", "off", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    # few shingles have more than one salt; the others need no second look at their hits
    hot = rarity.where("salts > 1").select("k", "h", "salts")
    salted = hits.withColumn("salt", F.lit(0).cast("long")) if hot.isEmpty() else hits.join(hot, ["k", "h"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "pos"), F.col("salts")), F.lit(0))).drop("salts")
    start = F.col("pos") - F.col("off")
    candidates = prefix.join(salted, ["k", "h", "salt"]).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    candidates = candidates.select("doc", "item", "part", "win", "len", "k", "start").distinct()
    parts = candidates.join(windows.select("item", "part", "win", "off", "h"), ["item", "part", "win"]).withColumn("pos", F.col("start") + F.col("off"))
    held = parts.join(hits.select("doc", "pos", "h", "k").distinct(), ["doc", "pos", "h", "k"])
    whole = held.groupBy("doc", "item", "part", "win", "start", "len", "k").agg(F.count("*").alias("n")).where(F.col("n") == F.col("len") - F.col("k") + 1)
    return whole.groupBy("doc", "item").agg(F.count("*").alias("n_windows"))
