"""Registered queries of the readers: chat exports are rebuilt from the messages and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import lexicons as L
from memlake.functions import text as X
from memlake.functions.embedding import HashingEmbedder, embed_column
from memlake.functions.porter import stemmed_tokens
from memlake.operators import layers
from memlake.operators import retrieval as R
from memlake.operators.store import first_writer
from memlake.plans.search_queries import docs, questions
from memlake.plans.tables import D, in_list, sql_trim, stored_drawers
from memlake.plans.text_queries import SQL as TEXT_SQL
from memlake.runtime import read_table
from memlake.sources.exports import transcripts
from memlake.sources.files import ProjectConfig, conversation_drawers, project_drawers, project_files
from memlake.streaming.ingest import windowed_counts


def _ordered(m, *fields):
    """(conv_id, messages) in order of turn and id."""
    return m.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("msg_id").alias("_m"), *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("messages"))


def _roles(s, d):
    return read_table(s, d, "messages").where("user_name IS NULL AND text IS NULL").select("conv_id", "turn", "msg_id", "role", "content")


def _role_files(s, d):
    return _ordered(_roles(s, d), "role", "content").select("conv_id", F.concat("conv_id", F.lit(".json")).alias("path"), F.to_json("messages").alias("content"))


def src_json_roles(s, d):
    """Transcripts; null where the array has no role in its first message and stays plain text."""
    return transcripts(_role_files(s, d)).select("conv_id", F.when(~F.startswith("transcript", F.lit("[{")), F.col("transcript")).alias("transcript"))


def src_json_slack(s, d):
    m = read_table(s, d, "messages").where("role IS NULL AND content IS NULL").select("conv_id", "turn", "msg_id", F.col("user_name").alias("user"), "text")
    f = _ordered(m, "user", "text").select("conv_id", F.concat("conv_id", F.lit(".json")).alias("path"), F.to_json("messages").alias("content"))
    return transcripts(f).select("conv_id", "transcript")


def src_jsonl(s, d):
    lines = F.array_join(F.transform("messages", lambda m: F.to_json(m)), "\n")
    f = _ordered(_roles(s, d), "role", "content").select("conv_id", F.concat("conv_id", F.lit(".jsonl")).alias("path"), F.concat(lines, F.lit("\nnot json\n\n")).alias("content"))
    return transcripts(f).select("conv_id", "transcript")


def src_json_tree(s, d):
    """Every conversation as a tree: its first message is the root, the others are its children in order."""
    m = _ordered(_roles(s, d), "msg_id", "role", "content")
    key = lambda x: x["msg_id"].cast("string")
    root = F.col("messages")[0]
    kids = F.transform(F.slice("messages", 2, 1 << 30), key)

    def node(x, i):
        parts = F.when(x["content"].isNull(), F.array().cast("array<string>")).otherwise(F.array(x["content"]))
        return F.struct(
            F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(parts.alias("parts")).alias("content")).alias("message"),
            F.when(i == 0, kids).otherwise(F.array().cast("array<string>")).alias("children"), F.when(i > 0, key(root)).alias("parent"),
        )

    tree = F.map_from_arrays(F.transform("messages", key), F.transform("messages", node))
    f = m.select("conv_id", F.concat("conv_id", F.lit(".json")).alias("path"), F.to_json(F.struct(tree.alias("mapping"))).alias("content"))
    return transcripts(f).select("conv_id", "transcript")


def src_text(s, d):
    f = read_table(s, d, "documents").select("doc_id", F.lit("a.txt").alias("path"), F.concat(F.lit(" \n"), F.coalesce("text", F.lit("")), F.lit("\t\n")).alias("content"))
    return transcripts(f).select("doc_id", F.md5("transcript").alias("md5"))


def src_fallback(s, d):
    f = read_table(s, d, "documents").select("doc_id", F.lit("a.json").alias("path"), "text").withColumnRenamed("text", "content")
    return transcripts(f).select("doc_id", F.md5("transcript").alias("md5"))


def src_convo(s, d):
    """Chat exports to drawers: read, cut into exchanges, classified, identified."""
    return conversation_drawers(_role_files(s, d), "wing_chat", "2026-01-01").select("id", "room", "source", "document")


def src_project(s, d):
    """Project files to drawers: all corpus texts under their source paths, those without one under ``unknown``."""
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    path = F.concat(source, F.lit("."), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".md"))
    f = project_files(read_table(s, d, "documents").select(path.alias("path"), F.col("text").alias("content")))
    return project_drawers(f, ProjectConfig("wing_files"), "2026-01-01").select("id", "room", F.octet_length("document").alias("bytes"))


def tx_trim(s, d):
    return read_table(s, d, "messages").where("text IS NOT NULL").select("msg_id", X.trim_space(F.concat(F.lit("\t  "), "text", F.lit("\n  "))).alias("text"))


def tx_story(s, d):
    return layers.story(stored_drawers(s, d))


def tx_wake(s, d):
    return layers.wake_up(stored_drawers(s, d), "/nonexistent")


def ret_recall(s, d):
    return layers.recall(stored_drawers(s, d), "wing_core", "design", 20).select("id", "seq")


def ret_bm25_porter(s, d):
    """BM25 over Porter stems, as the full-text index has them."""
    return R.bm25(docs(s, d), questions(s, d), 10, analyze=stemmed_tokens).select("query_id", "id", "position", F.round("rank", 6).alias("rank"))


def udf_embed(s, d):
    """Vectors of all drawers from the hashing backend, embedded in Arrow batches."""
    v = stored_drawers(s, d).select("id", embed_column(HashingEmbedder(64), F.col("document")).alias("vector"))
    return v.select("id", F.size("vector").alias("dims"), F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def agg_window(s, d):
    """Messages per day and role with a watermark; the plan that also runs as a stream."""
    m = read_table(s, d, "messages").where("sent_at IS NOT NULL").select("sent_at", F.coalesce("role", F.lit("")).alias("role"))
    w = windowed_counts(m, "sent_at")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "role", "n")


def set_union(s, d):
    """Texts of either form of message, first one wins per message."""
    m = read_table(s, d, "messages")
    both = m.select("msg_id", F.lit(0).alias("o"), F.col("content").alias("body")).unionByName(m.select("msg_id", F.lit(1).alias("o"), F.col("text").alias("body"))).where("body IS NOT NULL AND body <> ''")
    return first_writer(both, "msg_id", "o").select("msg_id", "body")


QUERIES = {f.__name__: f for f in (src_json_roles, src_json_slack, src_jsonl, src_json_tree, src_text, src_fallback, src_convo, src_project, tx_trim, tx_story, tx_wake, ret_recall, ret_bm25_porter, udf_embed, agg_window, set_union)}
_LINE = "CASE WHEN role = 'user' THEN '> user: ' || coalesce(content, '') ELSE role || ': ' || coalesce(content, '') END"
_M = "m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, msg_id) AS r FROM messages WHERE user_name IS NULL AND text IS NULL)"
#: The first message decides how an array is read: without a role it is no role transcript.
_FIRST = "f AS (SELECT conv_id, coalesce(role, '') AS first_role FROM m WHERE r = 1)"
_STORY = "'Palace has ' || count(*) || ' memories across ' || count(DISTINCT wing) || ' wings and ' || count(DISTINCT room) || ' rooms.' || chr(10) || 'Wings: ' || (SELECT string_agg(wing || ' (' || n || ')', ', ' ORDER BY wing) FROM (SELECT wing, count(*) AS n FROM d GROUP BY wing))"
SQL = {
    "src_json_slack": "SELECT conv_id, coalesce(string_agg(coalesce(nullif(user_name, ''), 'unknown') || ': ' || text, chr(10) ORDER BY turn NULLS FIRST, msg_id) FILTER (WHERE coalesce(text, '') <> ''), '') AS transcript FROM messages WHERE role IS NULL AND content IS NULL GROUP BY conv_id",
    "src_jsonl": f"SELECT conv_id, coalesce(string_agg({_LINE}, chr(10) ORDER BY turn NULLS FIRST, msg_id) FILTER (WHERE coalesce(role, '') <> ''), '') AS transcript FROM messages WHERE user_name IS NULL AND text IS NULL GROUP BY conv_id",
    "src_json_tree": f"SELECT conv_id, coalesce(string_agg({_LINE}, chr(10) ORDER BY turn NULLS FIRST, msg_id) FILTER (WHERE role IN ('user', 'assistant') AND {sql_trim('content')} <> ''), '') AS transcript FROM messages WHERE user_name IS NULL AND text IS NULL GROUP BY conv_id",
    "src_text": f"SELECT doc_id, md5({sql_trim('coalesce(text, ' + chr(39) * 2 + ')')}) AS md5 FROM documents",
    "src_fallback": f"SELECT doc_id, md5(CASE WHEN {sql_trim('coalesce(text, ' + chr(39) * 2 + ')')} = '' THEN '' ELSE text END) AS md5 FROM documents",
    "tx_trim": f"SELECT msg_id, {sql_trim('text')} AS text FROM messages WHERE text IS NOT NULL",
    "tx_story": f"WITH {D} SELECT {_STORY} AS story FROM d",
    "tx_wake": f"WITH {D} SELECT chr(10) || chr(10) || {_STORY} AS text FROM d",
    "ret_recall": f"WITH {D} SELECT id, seq FROM d WHERE wing = 'wing_core' AND room = 'design' ORDER BY seq LIMIT 20",
    "agg_window": "SELECT strftime(sent_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, coalesce(role, '') AS role, count(*) AS n FROM messages WHERE sent_at IS NOT NULL GROUP BY ALL",
    "set_union": "SELECT msg_id, coalesce(nullif(content, ''), nullif(text, '')) AS body FROM messages WHERE coalesce(nullif(content, ''), nullif(text, '')) IS NOT NULL",
}
SQL["src_json_roles"] = f"WITH {_M}, {_FIRST} SELECT conv_id, CASE WHEN first_role <> '' THEN transcript END AS transcript FROM ({SQL['src_jsonl']}) JOIN f USING (conv_id)"


def _project_sql() -> str:
    """The corpus as project files: paths checked against the deny lists, texts cut as by ``tx_chunk``, rooms by folder."""
    folders = ", ".join(f"('{w}', '{r}')" for r, ws in L.FOLDER_ROOMS.items() for w in ws.split())
    cut = TEXT_SQL["tx_chunk"].replace("SELECT doc_id, n, md5(chunk) AS chunk_md5, strlen(chunk) AS bytes FROM u", "")
    return f"""{cut}, folders(w, r) AS (VALUES {folders}),
 pth AS (SELECT doc_id, coalesce(nullif(source, ''), 'unknown') || '.' || doc_id || '.md' AS path FROM documents), seg AS (SELECT doc_id, path, string_split(path, '/') AS ps FROM pth),
 ok AS (SELECT doc_id, path, ps FROM seg WHERE NOT starts_with(ps[-1], '.') AND len(list_filter(ps[:-2], lambda x: x IN {in_list(L.SKIPPED_DIRS)} OR starts_with(x, '.'))) = 0),
 sg AS (SELECT doc_id, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM ok), rm AS (SELECT doc_id, arg_min(r, i) AS room FROM sg JOIN folders ON w = lower(part) GROUP BY doc_id),
 ch AS (SELECT md5('wing_files' || coalesce(room, 'general') || chunk) AS id, coalesce(room, 'general') AS room, strlen(chunk) AS bytes FROM u JOIN ok USING (doc_id) LEFT JOIN rm USING (doc_id))
 SELECT DISTINCT id, room, bytes FROM ch"""


SQL["src_project"] = _project_sql()
