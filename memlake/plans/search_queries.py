"""Registered queries of retrieval: the questions of ``eval_items`` against the whole corpus.

Question n also has a vector, that of ``vec_id`` n, where there is one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import text as X
from memlake.operators import evaluation as V
from memlake.operators import index as I
from memlake.operators import retrieval as R
from memlake.plans.tables import in_list
from memlake.runtime import read_table


def docs(s, d):
    return read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "wing", "lang")


def vectors(s, d):
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def questions(s, d):
    q = read_table(s, d, "eval_items").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), F.expr("try_cast(substr(question_id, 2) AS bigint)").alias("n"))
    return q.join(vectors(s, d).withColumnRenamed("id", "n"), "n", "left").drop("n")


def gold(s, d):
    """The corpus documents that hold a question word for word; questions are found by their rarest word."""
    q = questions(s, d)
    words = q.select("query_id", F.explode(F.array_distinct(X.tokens("query"))).alias("w"))
    found = docs(s, d).where("text IS NOT NULL").select("id", F.explode(F.array_distinct(X.tokens("text"))).alias("w")).join(words.select("w").distinct(), "w", "left_semi")
    df = found.groupBy("w").agg(F.count("*").alias("df"))
    rare = words.join(df, "w").groupBy("query_id").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    near = rare.join(found, "w").select("query_id", "id").join(q.select("query_id", "query"), "query_id").join(docs(s, d).select("id", "text"), "id")
    return near.where(F.contains("text", F.col("query"))).select("query_id", "id").distinct()


def ret_sanitize(s, d):
    return questions(s, d).select("query_id", F.array_join(F.transform(X.query_terms("query"), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ").alias("match"))


def ret_keywords(s, d):
    return docs(s, d).where("text IS NOT NULL").select("id", F.array_join(X.keywords("text"), " ").alias("keywords"))


def agg_tf(s, d):
    t = docs(s, d).where("text IS NOT NULL").select("id", F.explode(X.tokens("text")).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def flt_match(s, d):
    return R.bm25_scores(docs(s, d), questions(s, d), X.tokens).groupBy("query_id").agg(F.count("*").alias("n_matches"))


def ret_bm25(s, d):
    return R.bm25(docs(s, d), questions(s, d), 10, analyze=X.tokens).select("query_id", "id", "position", F.round("rank", 6).alias("rank"))


def ret_bm25_wing(s, d):
    return R.bm25(docs(s, d), questions(s, d), 5, F.col("wing") == "wing_core", X.tokens).select("query_id", "id", "position", F.round("rank", 6).alias("rank"))


def ret_hybrid(s, d):
    h = R.hybrid(docs(s, d), questions(s, d), 10, analyze=X.tokens)
    return h.select("query_id", "id", "position", F.round("overlap", 6).alias("overlap"), F.round("boosted", 6).alias("boosted"))


def ret_vector(s, d):
    v = vectors(s, d)
    q = v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector")
    return R.vector_search(v, q, 10).select("query_id", "id", "position", F.round("similarity", 6).alias("similarity"))


def jn_vec(s, d):
    """Documents of the drawers nearest to each query vector; vectors without a document are hidden."""
    v = vectors(s, d).join(docs(s, d).select("id"), "id", "left_semi")
    q = vectors(s, d).where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector")
    return R.vector_search(v, q, 5).join(docs(s, d).select("id", "wing"), "id").select("query_id", "id", "position", "wing")


def _legs(s, d, n):
    q = questions(s, d)
    return R.bm25(docs(s, d), q, n, analyze=X.tokens), R.vector_search(vectors(s, d), q.select("query_id", "vector"), n)


def ret_rrf(s, d):
    n = R.pool_size(10, 50)
    return R.fuse(*_legs(s, d, n), 10).select("query_id", "id", "position", F.round("score", 9).alias("score"))


def ret_classify(s, d):
    m = read_table(s, d, "messages").where("content IS NOT NULL")
    return m.select("msg_id", X.classify_query("content").alias("class"))


def ret_smart(s, d):
    r = R.smart(docs(s, d), vectors(s, d), questions(s, d), 10, analyze=X.tokens)
    return r.select("query_id", "id", "class", "position", F.round("score", 6).alias("score"))


def _in_core(c="wing"):
    return F.col(c) == "wing_core"


def ret_vector_wing(s, d):
    """Vectors of the documents of one wing."""
    v = vectors(s, d).join(docs(s, d).select("id", "wing"), "id")
    q = vectors(s, d).where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector")
    return R.vector_search(v, q, 10, _in_core()).select("query_id", "id", "position", F.round("similarity", 6).alias("similarity"))


def ret_hybrid_wing(s, d):
    h = R.hybrid(docs(s, d), questions(s, d), 10, where=_in_core(), analyze=X.tokens)
    return h.select("query_id", "id", "position", F.round("overlap", 6).alias("overlap"), F.round("boosted", 6).alias("boosted"))


def ret_rrf_wing(s, d):
    r = R.fused(docs(s, d), vectors(s, d), questions(s, d), 10, _in_core(), X.tokens)
    return r.select("query_id", "id", "position", F.round("score", 9).alias("score"))


def ret_smart_wing(s, d):
    r = R.smart(docs(s, d), vectors(s, d), questions(s, d), 10, _in_core(), X.tokens)
    return r.select("query_id", "id", "class", "position", F.round("score", 6).alias("score"))


def dml_fts_sync(s, d):
    """Hits of an index that was built of a part, then given the rest and an update, and lost some documents."""
    t = docs(s, d).select("id", "text")
    index = I.build(t.where("id % 3 = 0"), X.tokens)
    index = I.upsert(I.insert(index, t.where("id % 3 <> 0")), t.where("id % 7 = 0").withColumn("text", F.lower("text")))
    index = I.delete(index, t.where("id % 5 = 0"))
    return I.search(index, questions(s, d), 10).select("query_id", "id", "position", F.round("rank", 6).alias("rank"))


def svc_bench(s, d):
    """Every question against a haystack of its own: the chats whose digest begins with the question's number in hexadecimal."""
    part = F.lpad(F.lower(F.hex(F.expr("try_cast(substr(question_id, 2) AS bigint) % 256"))), 2, "0")
    q = read_table(s, d, "eval_items").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "question_type", part.alias("part"))
    m = read_table(s, d, "messages").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("session"), F.col("msg_id").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "content", F.left(F.md5("conv_id"), F.lit(2)).alias("part"))
    found = V.evaluate(q.join(m, "part").withColumn("gold", F.lower("content").contains("decid")).drop("part"), "raw", analyze=X.tokens)
    return found.select("query_id", "question_type", "rank", "found_at_5", "found_at_10")


def agg_recall(s, d):
    h = R.first_hits(R.bm25(docs(s, d), questions(s, d), 10, analyze=X.tokens), gold(s, d), questions(s, d))
    types = read_table(s, d, "eval_items").select(F.col("question_id").alias("query_id"), "question_type")
    mean = lambda c: F.round(F.avg(c), 6)
    return h.join(types, "query_id").groupBy("question_type").agg(F.count("*").alias("n"), mean("found_at_5").alias("r_at_5"), mean("found_at_10").alias("r_at_10"))


def win_first(s, d):
    return R.first_hits(R.bm25(docs(s, d), questions(s, d), 10, analyze=X.tokens), gold(s, d), questions(s, d))


QUERIES = {f.__name__: f for f in (ret_sanitize, ret_keywords, agg_tf, flt_match, ret_bm25, ret_bm25_wing, ret_hybrid, ret_vector, jn_vec, ret_rrf, ret_classify, ret_smart, ret_vector_wing, ret_hybrid_wing, ret_rrf_wing, ret_smart_wing, dml_fts_sync, svc_bench, agg_recall, win_first)}


def _like_any(x: str, signals: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in signals) + ")"


def _class(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') OR {_like_any(x, L.PREFERENCE_SIGNALS)} THEN 'PREFERENCE' WHEN {_like_any(x, L.TEMPORAL_SIGNALS)} THEN 'TEMPORAL' ELSE 'FACT' END"


_Q = """q AS (SELECT question_id AS query_id, question AS query, embedding AS vector FROM eval_items LEFT JOIN embeddings ON vec_id = TRY_CAST(substr(question_id, 2) AS BIGINT)),
 tk AS (SELECT doc_id AS id, wing, text, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS toks FROM documents WHERE text IS NOT NULL)"""
_TERMS = f"""w0 AS (SELECT query_id, list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda w: len(w) >= 2) AS ws FROM q),
 w1 AS (SELECT query_id, ws, list_filter(ws, lambda w: w NOT IN {in_list(L.SEARCH_STOP_WORDS)}) AS kept FROM w0)"""
_BM25 = f"""{_Q}, {_TERMS},
 qt AS (SELECT query_id, term, count(*) AS mult FROM (SELECT query_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE ws END) AS term FROM w1) GROUP BY ALL),
 st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk),
 tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf JOIN df USING (term), st),
 hits AS (SELECT query_id, id, round(-sum(score * mult), 9) AS rank FROM sc JOIN qt USING (term) GROUP BY ALL)"""
_TOP = lambda n, src="hits", order="rank, id": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM {src} QUALIFY position <= {n}"
_VEC = lambda q, v, n: f"""(SELECT q.query_id, v.id, round(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 9) AS similarity,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 9) DESC, v.id) AS position FROM {q} q, {v} v QUALIFY position <= {n})"""  # noqa: E731
_V = "v AS (SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE embedding IS NOT NULL), vq AS (SELECT id AS query_id, vector FROM v WHERE id % 50 = 0)"
_GOLD = "gold AS (SELECT query_id, id FROM q, tk WHERE contains(text, query)), firsts AS (SELECT q.query_id, coalesce(min(top.position), -1) AS rank FROM q LEFT JOIN gold USING (query_id) LEFT JOIN top ON top.query_id = gold.query_id AND top.id = gold.id GROUP BY q.query_id), fh AS (SELECT query_id, rank, CAST(rank BETWEEN 1 AND 5 AS INT) AS found_at_5, CAST(rank BETWEEN 1 AND 10 AS INT) AS found_at_10 FROM firsts)"
_RRF = lambda lw, sw, lex, sem: f"(SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, {lw} / (60 + position) AS part FROM {lex} UNION ALL SELECT query_id, id, {sw} / (60 + position) FROM {sem}) GROUP BY ALL)"

SQL = {
    "ret_sanitize": f"WITH {_Q}, {_TERMS} SELECT query_id, array_to_string(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, lambda w: '\"' || w || '\"'), ' OR ') AS match FROM w1",
    "ret_keywords": f"""WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 3 AND w NOT IN {in_list(L.KEYWORD_STOP_WORDS)}) AS ws FROM documents WHERE text IS NOT NULL)
 SELECT id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS keywords FROM w""",
    "agg_tf": f"WITH {_Q}, t AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tk) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM t GROUP BY term",
    "flt_match": f"WITH {_BM25} SELECT query_id, count(*) AS n_matches FROM hits GROUP BY query_id",
    "ret_bm25": f"WITH {_BM25} SELECT query_id, id, position, round(rank, 6) AS rank FROM ({_TOP(10)})",
    "ret_bm25_wing": f"WITH {_BM25}, f AS (SELECT hits.* FROM hits JOIN tk USING (id) WHERE wing = 'wing_core') SELECT query_id, id, position, round(rank, 6) AS rank FROM ({_TOP(5, 'f')})",
    "ret_hybrid": f"""WITH {_BM25}, pool AS ({_TOP(50)}), kw AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(query), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 3 AND w NOT IN {in_list(L.KEYWORD_STOP_WORDS)})) AS kws FROM q),
 o AS (SELECT query_id, id, rank, CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda k: contains(lower(text), k))) / len(kws) ELSE 0 END AS overlap FROM pool JOIN kw USING (query_id) JOIN tk USING (id)),
 b AS (SELECT query_id, id, overlap, round(rank * (1 - 0.3 * overlap), 9) AS boosted FROM o)
 SELECT query_id, id, position, round(overlap, 6) AS overlap, round(boosted, 6) AS boosted FROM ({_TOP(10, 'b', 'boosted, id')})""",
    "ret_vector": f"WITH {_V} SELECT query_id, id, position, round(similarity, 6) AS similarity FROM {_VEC('vq', 'v', 10)}",
    "jn_vec": f"WITH {_V}, vd AS (SELECT * FROM v WHERE id IN (SELECT doc_id FROM documents)) SELECT query_id, id, position, wing FROM {_VEC('vq', 'vd', 5)} JOIN documents ON doc_id = id",
    "ret_rrf": f"WITH {_BM25}, {_V}, lex AS ({_TOP(50)}), qv AS (SELECT query_id, vector FROM q WHERE vector IS NOT NULL), sem AS (FROM {_VEC('qv', 'v', 50)}), f AS (SELECT query_id, id, round(score, 12) AS score FROM {_RRF('1.0', '1.5', 'lex', 'sem')}) SELECT query_id, id, position, round(score, 9) AS score FROM ({_TOP(10, 'f', 'score DESC, id')})",
    "ret_classify": f"SELECT msg_id, {_class('content')} AS class FROM messages WHERE content IS NOT NULL",
    "ret_smart": f"""WITH {_BM25}, {_V}, c AS (SELECT query_id, vector, CASE WHEN vector IS NULL THEN 'LEXICAL' ELSE {_class('query')} END AS class FROM q),
 lex AS (SELECT t.*, class FROM ({_TOP(50)}) t JOIN c USING (query_id) WHERE class <> 'PREFERENCE'), qv AS (SELECT query_id, vector FROM c WHERE class <> 'LEXICAL'),
 sem AS (SELECT t.*, class FROM {_VEC('qv', 'v', 50)} t JOIN c USING (query_id)),
 f AS (SELECT query_id, id, round(score, 12) AS score FROM {_RRF("CASE class WHEN 'TEMPORAL' THEN 1.0 ELSE 1.5 END", "CASE class WHEN 'TEMPORAL' THEN 1.5 ELSE 1.0 END", "lex WHERE class IN ('TEMPORAL', 'FACT')", "sem WHERE class IN ('TEMPORAL', 'FACT')")}),
 r AS (SELECT query_id, id, score, position FROM ({_TOP(10, 'f', 'score DESC, id')}) UNION ALL SELECT query_id, id, similarity, position FROM sem WHERE class = 'PREFERENCE' AND position <= 10 UNION ALL SELECT query_id, id, -rank, position FROM lex WHERE class = 'LEXICAL' AND position <= 10)
 SELECT query_id, id, class, position, round(score, 6) AS score FROM r JOIN c USING (query_id)""",
    "agg_recall": f"WITH {_BM25}, top AS ({_TOP(10)}), {_GOLD} SELECT question_type, count(*) AS n, round(avg(found_at_5), 6) AS r_at_5, round(avg(found_at_10), 6) AS r_at_10 FROM fh JOIN eval_items ON question_id = query_id GROUP BY question_type",
    "win_first": f"WITH {_BM25}, top AS ({_TOP(10)}), {_GOLD} SELECT query_id, rank, found_at_5, found_at_10 FROM fh",
}
_WING = "cw AS (SELECT hits.* FROM hits JOIN tk USING (id) WHERE wing = 'wing_core'), vw AS (SELECT * FROM v WHERE id IN (SELECT doc_id FROM documents WHERE wing = 'wing_core'))"
SQL["ret_vector_wing"] = f"WITH {_V}, vd AS (SELECT * FROM v WHERE id IN (SELECT doc_id FROM documents WHERE wing = 'wing_core')) SELECT query_id, id, position, round(similarity, 6) AS similarity FROM {_VEC('vq', 'vd', 10)}"
SQL["ret_hybrid_wing"] = SQL["ret_hybrid"].replace(f"pool AS ({_TOP(50)})", f"cw AS (SELECT hits.* FROM hits JOIN tk USING (id) WHERE wing = 'wing_core'), pool AS ({_TOP(50, 'cw')})")
for _name in ("ret_rrf", "ret_smart"):
    _sql = SQL[_name].replace(f"{_V},", f"{_V}, {_WING},", 1).replace(_TOP(50), _TOP(50, "cw")).replace(_VEC("qv", "v", 50), _VEC("qv", "vw", 50))
    SQL[f"{_name}_wing"] = _sql
SQL["dml_fts_sync"] = SQL["ret_bm25"].replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0")
SQL["svc_bench"] = f"""WITH q AS (SELECT question_id AS query_id, question AS query, question_type, printf('%02x', TRY_CAST(substr(question_id, 2) AS BIGINT) % 256) AS part FROM eval_items), {_TERMS},
 s AS (SELECT substr(md5(conv_id), 1, 2) AS part, conv_id AS id, coalesce(string_agg(coalesce(content, ''), chr(10) ORDER BY msg_id) FILTER (WHERE role = 'user'), '') AS text, coalesce(bool_or(contains(lower(content), 'decid')), false) AS gold FROM messages WHERE conv_id IS NOT NULL GROUP BY conv_id),
 tk AS (SELECT part, id, gold, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS toks FROM s),
 qt AS (SELECT query_id, part, term, count(*) AS mult FROM (SELECT query_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE ws END) AS term FROM w1) JOIN q USING (query_id) GROUP BY ALL),
 st AS (SELECT part, count(*) AS n, avg(len(toks)) AS avgdl FROM tk GROUP BY part), tf AS (SELECT part, id, dl, term, count(*) AS tf FROM (SELECT part, id, len(toks) AS dl, unnest(toks) AS term FROM tk) GROUP BY ALL),
 df AS (SELECT part, term, count(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT part, id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf JOIN df USING (part, term) JOIN st USING (part)),
 hits AS (SELECT query_id, id, round(-sum(score * mult), 9) AS rank FROM sc JOIN qt USING (part, term) GROUP BY ALL), top AS ({_TOP(10)}),
 f AS (SELECT query_id, question_type, coalesce(min(position) FILTER (WHERE gold), -1) AS rank FROM q LEFT JOIN top USING (query_id) LEFT JOIN tk USING (id) WHERE q.part IN (SELECT part FROM tk) GROUP BY ALL)
 SELECT query_id, question_type, rank, CAST(rank BETWEEN 1 AND 5 AS INT) AS found_at_5, CAST(rank BETWEEN 1 AND 10 AS INT) AS found_at_10 FROM f"""
