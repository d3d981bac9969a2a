"""Retrieval over many queries at once: BM25, vectors, their fusion and routing.

Every operator takes a table of queries and gives (query_id, id, position, …) of the best ``limit`` hits of
each. Texts are analyzed as folded words and their Porter stems, as the full-text index has them; ``X.tokens`` gives
words without stems. ``where`` filters documents; statistics stay those of all. Defined results: null or empty texts match nothing; a query without terms has no hits; limits of 0 or
less mean 10; ties go to the smaller id; repeated query terms count twice; vectors of zero length or null
have cosine 0, another number of dimensions is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import text as X
from memlake.functions.porter import stemmed_tokens
from memlake.runtime import is_small, written


def top(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each query with their position from 1; limits are pushed below the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= (limit if limit > 0 else 10))


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, mult): the phrases of ``queries(query_id, query)`` with their multiplicity."""
    terms = queries.select("query_id", F.explode(X.query_terms("query")).alias("phrase"))
    return terms.groupBy("query_id", "phrase").agg(F.count("*").alias("mult"))


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def asked_words(queries: DataFrame, analyze, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, phrase, mult) of the queries, and (phrase, k, off, token): the words of every phrase."""
    asked = written(phrases(queries) if not keys else phrases(queries).join(queries.select("query_id", *keys), "query_id"))
    words = asked.select("phrase").distinct().select("phrase", analyze(F.translate("phrase", "_", " ")).alias("words"))
    return asked, written(words.select("phrase", F.size("words").alias("k"), F.posexplode("words").alias("off", "token")))


def match_scores(placed: DataFrame, stats: DataFrame, asked: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, id, rank) of the phrases of ``placed(id, dl, token, pos)``, with statistics per ``keys``.

    The queries are joined last and from every executor's copy while they are small, so a phrase that a third of
    the documents hold is not brought into one task; larger ones are joined by phrase.
    """
    runs = placed.join(_if_small(parts), "token").groupBy(*keys, "id", "phrase", "k", (F.col("pos") - F.col("off")).alias("start")).agg(F.first("dl").alias("dl"), F.count("*").alias("found"))
    tf = written(runs.where(F.col("found") == F.col("k")).groupBy(*keys, "id", "phrase").agg(F.first("dl").alias("dl"), F.count("*").alias("tf")))
    df = written(tf.groupBy(*keys, "phrase").agg(F.count("*").alias("df")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = tf.join(_if_small(df), [*keys, "phrase"])
    weighted = weighted.join(stats, keys) if keys else weighted.crossJoin(F.broadcast(stats))  # one row without keys
    score = F.when(idf > 0, idf).otherwise(L.IDF_FLOOR) * F.col("tf") * (L.BM25_K1 + 1) / (F.col("tf") + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.col("dl") / F.col("avgdl")))
    hits = weighted.select(*keys, "id", "phrase", score.alias("score")).join(_if_small(asked), [*keys, "phrase"])
    return hits.groupBy("query_id", "id").agg((-F.sum(F.col("score") * F.col("mult"))).alias("rank"))


def bm25_scores(docs: DataFrame, queries: DataFrame, analyze=stemmed_tokens, group: str | None = None) -> DataFrame:
    """(query_id, id, rank) of all matches of ``docs(id, text)``; lower ranks are better.

    Statistics are those of all documents, or of those of the query's ``group``, a column of both tables. Only tokens
    that some query asks for leave the scan, and a phrase such as ``foo_bar`` has to stand with its words next to each
    other. ``memlake.operators.index`` keeps the analyzed corpus between searches.
    """
    keys = [group] if group else []
    asked, parts = asked_words(queries, analyze, keys)
    # one pass over the texts: the analyzed corpus is written once and read for statistics and for matches
    analyzed = written(docs.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(*keys, "id", analyze("text").alias("tokens")))
    stats = analyzed.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    placed = analyzed.select(*keys, "id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "token")).join(_if_small(parts.select("token").distinct()), "token", "left_semi")
    return match_scores(placed, stats, asked, parts, keys)


def best(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of (query_id, id, rank) with their position."""
    return top(hits.withColumn("rank", F.round("rank", 9)), limit, F.col("rank"), F.col("id"))


def bm25(docs: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None, analyze=stemmed_tokens) -> DataFrame:
    """(query_id, id, rank, position); ``where`` filters the documents after scoring, as statistics stay global."""
    hits = bm25_scores(docs, queries, analyze)
    if where is not None:
        hits = hits.join(docs.where(where).select("id"), "id", "left_semi")
    return best(hits, limit)


def _blocks(batches):
    """Every Arrow batch as one row: the ids and the matrix of unit vectors."""
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(v) % b.num_rows:
            raise ValueError("vectors of different dimensions")
        v = v.reshape(b.num_rows, -1)
        n = np.linalg.norm(v, axis=1)
        unit = v / np.where(n > 0, n, 1)[:, None]
        ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
        yield pa.RecordBatch.from_arrays([ids, pa.array([unit.tobytes()], pa.binary()), pa.array([unit.shape[1]], pa.int32())], names=["ids", "unit", "dims"])


def _best(keep: int):
    """The best ``keep`` rows of a block for every query of another block."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                if b.column(2)[i].as_py() != b.column(5)[i].as_py():
                    raise ValueError("vectors of another number of dimensions than the queries")
                own, asked = b.column(0)[i].values, b.column(3)[i].values
                v, q = (np.frombuffer(b.column(c)[i].as_buffer()).reshape(-1, b.column(2)[i].as_py()) for c in (1, 4))
                sims = np.round(v @ q.T, 9)
                rank = own.to_numpy(zero_copy_only=False)
                order = np.lexsort((np.broadcast_to(rank[:, None], sims.shape), -sims), axis=0)[:keep]
                ask = np.broadcast_to(np.arange(sims.shape[1]), order.shape)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(ask.ravel())), own.take(pa.array(order.ravel())), pa.array(np.take_along_axis(sims, order, axis=0).ravel())], names=["query_id", "id", "similarity"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, position) by cosine, of ``vectors(id, vector)`` for ``queries(query_id, vector)``.

    ``where`` filters the vectors by their other columns before the search.

    Rows and queries are packed into blocks, one matrix per Arrow batch. Every block of queries goes through
    every block of rows as one matrix product, of which only the best ``limit`` rows per query leave the task.
    """
    limit = limit if limit > 0 else 10
    q_kind, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    packed = lambda df, key, k: df.where(F.col("vector").isNotNull() & F.col(key).isNotNull()).select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_blocks, f"ids array<{k}>, unit binary, dims int")
    rows = packed(vectors if where is None else vectors.where(where), "id", kind)
    asked = packed(queries, "query_id", q_kind).select(F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"), F.col("dims").alias("q_dims"))
    pairs = rows.crossJoin(asked)  # block by block: one row per pair of matrices
    hits = pairs.mapInArrow(_best(limit), f"query_id {q_kind}, id {kind}, similarity double")
    return top(hits, limit, F.col("similarity").desc(), F.col("id"))


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int, lexical_weight: float | Column = L.RRF_BM25_WEIGHT, semantic_weight: float | Column = L.RRF_VECTOR_WEIGHT) -> DataFrame:
    """(query_id, id, score, position): reciprocal rank fusion of two lists with positions from 1.

    The weights may be columns of the lists. A document missing from a list gets nothing for it.
    """
    part = lambda hits, w: hits.select("query_id", "id", ((F.lit(w) if isinstance(w, (int, float)) else w) / (F.lit(L.RRF_K) + F.col("position"))).alias("part"))
    both = part(lexical, lexical_weight).unionAll(part(semantic, semantic_weight))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"))
    return top(fused, limit, F.col("score").desc(), F.col("id"))


def pool_size(limit: int, least: int) -> int:
    return max(least, 5 * limit)


def rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, limit: int, boost: str = "literal") -> DataFrame:
    """(query_id, id, rank, overlap, boosted, position): a pool of hits reordered by keyword overlap.

    Only the texts of the pool are fetched; ``pool`` and ``docs`` are joined on all columns of a document's key.
    """
    key = [c for c in ("grp", "id") if c in docs.columns and c in pool.columns]
    texts = docs.select(*key, "text").join(pool.select(*key).distinct(), key, "left_semi")
    rows = pool.join(texts, key).join(queries.select("query_id", X.keywords("query").alias("kw")), "query_id")
    sign = -1 if boost == "literal" else 1
    rows = rows.select("query_id", "id", "rank", X.keyword_overlap(F.col("kw"), "text").alias("overlap")).withColumn("boosted", F.round(F.col("rank") * (1 + sign * L.HYBRID_BOOST * F.col("overlap")), 9))
    return top(rows, limit, F.col("boosted"), F.col("id"))


def hybrid(docs: DataFrame, queries: DataFrame, limit: int = 10, boost: str = "literal", where: Column | None = None, analyze=stemmed_tokens) -> DataFrame:
    """(query_id, id, rank, overlap, boosted, position): BM25 candidates reranked by keyword overlap.

    ``literal`` multiplies ranks, which are negative, by 1 - 0.3 overlap; ``corrected`` by 1 + 0.3 overlap.
    """
    pool = written(bm25(docs, queries, pool_size(limit, 20), where, analyze).drop("position"))
    return rerank(pool, docs, queries, limit, boost)


def fused(docs: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None, analyze=stemmed_tokens) -> DataFrame:
    """(query_id, id, score, position): fusion of both searches for ``queries(query_id, query, vector)``.

    ``where`` filters both legs; it names columns of ``docs``.
    """
    n = pool_size(limit, 50)
    kept = vectors if where is None else vectors.join(docs.where(where).select("id"), "id", "left_semi")
    return fuse(bm25(docs, queries, n, where, analyze), vector_search(kept, queries.select("query_id", "vector"), n), limit)


def classes(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query, vector)`` with their class; a query without a vector goes to BM25 alone."""
    return queries.withColumn("class", F.when(F.col("vector").isNull(), "LEXICAL").otherwise(X.classify_query("query")))


def route(classed: DataFrame, lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, class, score, position): every query by its class from the hits of both searches.

    Preferences go to vectors alone, temporal queries and facts to fusion with their own weights.
    """
    kinds = classed.select("query_id", "class")
    weight = lambda i: F.when(F.col("class") == "TEMPORAL", L.ROUTER_WEIGHTS["TEMPORAL"][i]).otherwise(L.ROUTER_WEIGHTS["FACT"][i])
    lex, sem = lexical.join(kinds, "query_id"), semantic.join(kinds, "query_id")
    mixed = ["TEMPORAL", "FACT"]
    both = fuse(lex.where(F.col("class").isin(mixed)), sem.where(F.col("class").isin(mixed)), limit, weight(0), weight(1))
    alone = sem.where("class = 'PREFERENCE'").select("query_id", "id", F.col("similarity").alias("score"), "position")
    plain = lex.where("class = 'LEXICAL'").select("query_id", "id", (-F.col("rank")).alias("score"), "position")
    rest = alone.unionByName(plain).where(F.col("position") <= limit)
    return both.unionByName(rest).join(kinds, "query_id").select("query_id", "id", "class", "score", "position")


def smart(docs: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None, analyze=stemmed_tokens) -> DataFrame:
    """(query_id, id, class, score, position): each query of ``queries(query_id, query, vector)`` by its class.

    ``where`` filters both searches; it names columns of ``docs``.
    """
    classed, n = classes(queries), pool_size(limit, 50)
    kept = vectors if where is None else vectors.join(docs.where(where).select("id"), "id", "left_semi")
    lexical = bm25(docs, classed.where("class != 'PREFERENCE'"), n, where, analyze).select("query_id", "id", "position", "rank")
    semantic = vector_search(kept, classed.where("class != 'LEXICAL'").select("query_id", "vector"), n)
    return route(classed, lexical, semantic, limit)


def first_hits(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, found_at_5, found_at_10): position of the first gold hit of each query, -1 without."""
    first = hits.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("position").alias("rank"))
    out = queries.select("query_id").join(first, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    at = lambda k: ((F.col("rank") > 0) & (F.col("rank") <= k)).cast("int")
    return out.select("query_id", "rank", at(5).alias("found_at_5"), at(10).alias("found_at_10"))
