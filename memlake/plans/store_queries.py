"""Registered queries over the drawer store, the messages and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import entities as E
from memlake.operators import graph as G
from memlake.operators import store as S
from memlake.plans.tables import D, DOC, document_drawers, stored_drawers
from memlake.runtime import read_table

WING, ROOM, DAY = "wing_core", "design", "2026-01-01"


def src_get(s, d):
    return S.get(stored_drawers(s, d), S.Query()).select("seq", *S.DRAWER)


def flt_where(s, d):
    return S.get(stored_drawers(s, d), S.Query(wing=WING, room=ROOM)).select("id", "wing", "room", "source")


def lim_page(s, d):
    return S.get(stored_drawers(s, d), S.Query(wing=WING, limit=20, offset=5)).select("id", "seq")


def prj_nohall(s, d):
    return stored_drawers(s, d).drop("hall", "seq")


def snk_print(s, d):
    return stored_drawers(s, d).select("id", X.shown("document").alias("shown"))


def dml_add(s, d):
    return S.insert(S.first_writer(document_drawers(s, d)), stored_drawers(s, d)).select("id", "seq", "wing", "room")


def dml_upsert(s, d):
    changed = stored_drawers(s, d).unionByName(document_drawers(s, d).withColumn("hall", F.lit("again")))
    return S.upsert(stored_drawers(s, d), changed).select("id", "seq", "hall")


def unlabelled(s, d):
    return read_table(s, d, "drawer_labels").where("lang_label IS NULL OR lang_label IN ('', 'und', 'unknown', 'n/a')").select(F.col("drawer_id").alias("id"))


def dml_delete(s, d):
    return S.delete(stored_drawers(s, d), unlabelled(s, d)).select("id", "seq")


def dml_entity(s, d):
    return S.add_entities(read_table(s, d, "entities"), read_table(s, d, "registry"))


def dml_triple(s, d):
    t, r = read_table(s, d, "triples"), read_table(s, d, "registry")
    facts = r.where("name IS NOT NULL").join(dml_entity(s, d), "name").select(F.col("id").alias("subject_id"), F.lit("is_a").alias("predicate"), F.coalesce("type", F.lit("")).alias("object"), F.lit(DAY).alias("valid_from"), F.lit("").alias("valid_to"))
    old = t.where("subject_id IS NOT NULL").select("subject_id", "predicate", "object", "valid_from", F.coalesce("valid_to", F.lit("")).alias("valid_to"))
    return old.unionByName(facts).groupBy("subject_id", "predicate").agg(F.count("*").alias("n_facts"), F.countDistinct("object").alias("n_objects"))


def dml_invalidate(s, d):
    t = read_table(s, d, "triples")
    done = t.where("predicate = 'works_on'").select("subject_id", "predicate", "object")
    return S.invalidate(t, done, DAY).select("id", "valid_to")


def dml_registry(s, d):
    e = read_table(s, d, "entities").select((F.col("id") + 1000000).alias("ord"), "name", F.lit("person").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("mined").alias("source"), F.lit("").alias("code"))
    all_, _ = E.register(read_table(s, d, "registry"), e)
    return all_.select("ord", "name", "source")


def jn_alias(s, d):
    return E.lookup(read_table(s, d, "registry"), read_table(s, d, "entities").select("id", "name")).select("id", F.col("entry_ord").cast("string").alias("entry_ord"), "entry", "entry_type", "entry_code")


def agg_count(s, d):
    return stored_drawers(s, d).agg(F.count("*").alias("n"))


def agg_wings(s, d):
    return stored_drawers(s, d).groupBy("wing").agg(F.count("*").alias("drawers"))


def agg_rooms(s, d):
    return stored_drawers(s, d).where(F.col("wing") == WING).groupBy("room").agg(F.count("*").alias("drawers"))


def agg_status(s, d):
    return stored_drawers(s, d).rollup("wing", "room").agg(F.count("*").alias("drawers"))


def agg_story(s, d):
    t = stored_drawers(s, d)
    per = t.groupBy("wing").agg(F.count("*").alias("n")).agg(F.expr("listagg(concat(wing, ': ', n), ', ') WITHIN GROUP (ORDER BY wing)").alias("per_wing"))
    return t.agg(F.count("*").alias("drawers"), F.countDistinct("wing").alias("wings"), F.countDistinct("room").alias("room_names")).crossJoin(per)


def agg_palace(s, d):
    return G.palace_stats(stored_drawers(s, d))


def src_fmt(s, d):
    m = read_table(s, d, "messages").where("role IS NOT NULL AND role <> '' AND content IS NOT NULL")
    return m.select("msg_id", X.message_line("role", "content").alias("line"))


def flt_user(s, d):
    m = read_table(s, d, "messages").where("role = 'user' AND content IS NOT NULL")
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "msg_id", "content"))), lambda x: x["content"]), "\n").alias("document"))


QUERIES = {f.__name__: f for f in (src_get, flt_where, lim_page, prj_nohall, snk_print, dml_add, dml_upsert, dml_delete, dml_entity, dml_triple, dml_invalidate, dml_registry, jn_alias, agg_count, agg_wings, agg_rooms, agg_status, agg_story, agg_palace, src_fmt, flt_user)}

_NEW_ENTITIES = """fresh AS (SELECT DISTINCT name FROM registry WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM entities)),
 ent AS (SELECT id, name FROM entities UNION ALL SELECT (SELECT max(id) FROM entities) + row_number() OVER (ORDER BY encode(name)), name FROM fresh)"""
_KEYS = """keys AS (SELECT lower(k) AS key, min(ord) AS ord FROM (SELECT ord, unnest(list_concat([name], coalesce(aliases, []))) AS k FROM registry) WHERE k IS NOT NULL GROUP BY 1)"""
_EDGES = """rs AS (SELECT DISTINCT wing || '/' || room AS node, source FROM d WHERE source <> ''), edges AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM rs a JOIN rs b ON a.source = b.source AND a.node <> b.node)"""
SQL = {
    "src_get": f"WITH {D} SELECT * FROM d",
    "flt_where": f"WITH {D} SELECT id, wing, room, source FROM d WHERE wing = '{WING}' AND room = '{ROOM}'",
    "lim_page": f"WITH {D} SELECT id, seq FROM d WHERE wing = '{WING}' ORDER BY seq LIMIT 20 OFFSET 5",
    "prj_nohall": f"WITH {D} SELECT * EXCLUDE (hall, seq) FROM d",
    "snk_print": f"WITH {D} SELECT id, CASE WHEN strlen(document) > 500 THEN left(document, 500) || '...' ELSE document END AS shown FROM d",
    "dml_add": f"WITH {D}, {DOC}, old AS (SELECT * FROM docd QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) SELECT id, seq, wing, room FROM old UNION ALL SELECT id, seq, wing, room FROM d WHERE id NOT IN (SELECT id FROM old)",
    "dml_upsert": f"""WITH {D}, {DOC}, new AS (SELECT id, seq, hall FROM (SELECT id, seq, hall FROM d UNION ALL SELECT id, seq, 'again' FROM docd) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
 SELECT n.id, coalesce(d.seq, n.seq) AS seq, n.hall FROM new n LEFT JOIN d ON d.id = n.id""",
    "dml_delete": f"WITH {D} SELECT id, seq FROM d WHERE id NOT IN (SELECT drawer_id FROM drawer_labels WHERE (lang_label IS NULL OR lang_label IN ('', 'und', 'unknown', 'n/a')) AND drawer_id IS NOT NULL)",
    "dml_entity": f"WITH {_NEW_ENTITIES} SELECT id, name FROM ent",
    "dml_triple": f"""WITH {_NEW_ENTITIES}, f AS (SELECT subject_id, predicate, object FROM triples WHERE subject_id IS NOT NULL UNION ALL SELECT ent.id, 'is_a', coalesce(r.type, '') FROM registry r JOIN ent ON ent.name = r.name)
 SELECT subject_id, predicate, count(*) AS n_facts, count(DISTINCT object) AS n_objects FROM f GROUP BY ALL""",
    "dml_invalidate": f"SELECT id, CASE WHEN predicate = 'works_on' AND coalesce(valid_to, '') = '' AND subject_id IS NOT NULL AND object IS NOT NULL THEN '{DAY}' ELSE coalesce(valid_to, '') END AS valid_to FROM triples",
    "dml_registry": f"""WITH {_KEYS}, e AS (SELECT id + 1000000 AS ord, name FROM entities WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY id) = 1)
 SELECT ord, name, source FROM registry UNION ALL SELECT ord, name, 'mined' FROM e WHERE lower(name) NOT IN (SELECT key FROM keys)""",
    "jn_alias": f"WITH {_KEYS} SELECT e.id, CAST(r.ord AS VARCHAR) AS entry_ord, r.name AS entry, r.type AS entry_type, r.code AS entry_code FROM entities e LEFT JOIN keys k ON k.key = lower(e.name) LEFT JOIN registry r ON r.ord = k.ord",
    "agg_count": f"WITH {D} SELECT count(*) AS n FROM d",
    "agg_wings": f"WITH {D} SELECT wing, count(*) AS drawers FROM d GROUP BY wing",
    "agg_rooms": f"WITH {D} SELECT room, count(*) AS drawers FROM d WHERE wing = '{WING}' GROUP BY room",
    "agg_status": f"WITH {D} SELECT wing, room, count(*) AS drawers FROM d GROUP BY ROLLUP (wing, room)",
    "agg_story": f"WITH {D} SELECT count(*) AS drawers, count(DISTINCT wing) AS wings, count(DISTINCT room) AS room_names, (SELECT string_agg(wing || ': ' || n, ', ' ORDER BY wing) FROM (SELECT wing, count(*) AS n FROM d GROUP BY wing)) AS per_wing FROM d",
    "agg_palace": f"WITH {D}, {_EDGES} SELECT count(DISTINCT wing) AS wings, count(DISTINCT wing || '/' || room) AS rooms, count(*) AS drawers, (SELECT count(*) // 2 FROM edges) AS connections FROM d",
    "src_fmt": "SELECT msg_id, CASE WHEN role = 'user' THEN '> user: ' || content ELSE role || ': ' || content END AS line FROM messages WHERE role IS NOT NULL AND role <> '' AND content IS NOT NULL",
    "flt_user": "SELECT conv_id, string_agg(content, chr(10) ORDER BY turn NULLS FIRST, msg_id) AS document FROM messages WHERE role = 'user' AND content IS NOT NULL GROUP BY conv_id",
}
