"""Evaluation of retrieval where every question has a haystack of its own.

Defined results: sessions without user turns are empty documents; a question without gold sessions or hits has rank
-1; a question without a haystack has no hits; repeated sessions count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.porter import stemmed_tokens
from memlake.operators import retrieval as R
from memlake.runtime import written

MODES = ("raw", "hybrid", "vector", "fused", "smart")


def sessions(messages: DataFrame) -> DataFrame:
    """(query_id, id, text, gold): the user turns of every session, in order, joined by line breaks."""
    said = F.when(F.col("role") == "user", F.struct("turn", F.coalesce("content", F.lit("")).alias("content")))
    rows = messages.where(F.col("session").isNotNull()).groupBy("query_id", F.col("session").alias("id")).agg(F.array_sort(F.collect_set(said)).alias("said"), F.max("gold").alias("gold"))
    return rows.select("query_id", "id", F.array_join("said.content", "\n").alias("text"), F.coalesce("gold", F.lit(False)).alias("gold"))


def near(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, similarity, position): cosine within the haystack of each question."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    v, q = F.col("vector").cast("array<double>"), F.col("asked").cast("array<double>")
    norm = F.sqrt(dot(v, v) * dot(q, q))
    both = vectors.where("vector IS NOT NULL").join(queries.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("asked")), "query_id")
    hits = both.select("query_id", "id", F.round(F.when(norm > 0, dot(v, q) / norm).otherwise(0.0), 9).alias("similarity"))
    return R.top(hits, limit, F.col("similarity").desc(), F.col("id"))


def evaluate(messages: DataFrame, mode: str = "raw", embed=None, limit: int = 10, analyze=stemmed_tokens) -> DataFrame:
    """(query_id, question_type, rank, found_at_5, found_at_10) of every question of ``read_questions`` in one plan.

    Statistics are those of the question's own haystack. ``embed`` maps a text column to a vector column; without
    one the vector modes fall back to ``raw``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    mode = mode if embed or mode in ("raw", "hybrid") else "raw"
    kind = F.max("question_type") if "question_type" in messages.columns else F.lit(None).cast("string")
    queries = messages.groupBy("query_id").agg(F.max("query").alias("query"), kind.alias("question_type"))
    docs = written(sessions(messages))
    vector: Column = embed(F.col("query")) if embed else F.lit(None).cast("array<float>")
    asked = written(queries.withColumn("vector", vector).withColumn("grp", F.col("query_id")))
    grouped = docs.withColumnRenamed("query_id", "grp")
    n = limit if mode == "raw" else R.pool_size(limit, 20 if mode == "hybrid" else 50)
    lexical = lambda q: R.best(R.bm25_scores(grouped, q, analyze, "grp"), n)
    semantic = lambda q, k: near(docs.withColumn("vector", embed(F.col("text"))), q, k)
    if mode == "raw":
        hits = lexical(asked)
    elif mode == "hybrid":
        hits = R.rerank(lexical(asked).drop("position").withColumn("grp", F.col("query_id")), grouped, asked, limit)
    elif mode == "vector":
        hits = semantic(asked, limit)
    elif mode == "fused":
        hits = R.fuse(lexical(asked), semantic(asked, n), limit)
    else:
        classed = R.classes(asked)
        hits = R.route(classed, lexical(classed.where("class != 'PREFERENCE'")), semantic(classed, n), limit)
    first = R.first_hits(hits.select("query_id", "id", "position"), docs.where("gold").select("query_id", "id"), queries)
    return queries.select("query_id", "question_type").join(first, "query_id")
