"""Registered queries of the text operators, over whole drawers, documents and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import text as X
from memlake.operators import dialect as C
from memlake.operators import entities as E
from memlake.plans.tables import D, in_list, sql_trim, stored_drawers
from memlake.runtime import read_table


def _docs(s, d):
    return read_table(s, d, "documents").where("text IS NOT NULL")


def tx_chunk(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(X.chunks("text")).alias("n", "chunk")).select("doc_id", "n", F.md5("chunk").alias("chunk_md5"), F.octet_length("chunk").alias("bytes"))


def tx_exch(s, d):
    return stored_drawers(s, d).select("id", F.posexplode(X.exchanges("document")).alias("n", "exchange"))


def win_group(s, d):
    return stored_drawers(s, d).select("id", F.posexplode(X.grouped(X.exchanges("document"), 3)).alias("n", "chunk"))


def tx_convroom(s, d):
    return stored_drawers(s, d).select("id", X.conversation_room("document").alias("room"))


def tx_pathroom(s, d):
    return stored_drawers(s, d).where("source <> ''").select("source").distinct().select("source", X.path_room("source", ["exports"]).alias("room"))


def tx_id(s, d):
    return stored_drawers(s, d).select("seq", "id", X.drawer_id("wing", "room", "document").alias("content_id"))


def tx_sent(s, d):
    return stored_drawers(s, d).select("id", F.posexplode(X.sentences("document")).alias("n", "sentence"))


def tx_memory(s, d):
    t = stored_drawers(s, d).select("id", F.posexplode(X.sentences("document")).alias("n", "sentence"))
    return C.memories(t, "sentence").select("id", "n", "type", "score", "sentence")


def tx_ents(s, d):
    return E.detect_entities(stored_drawers(s, d), "id", "document").select(F.col("key").alias("id"), "name", "freq", "person", "project", "type", "confidence")


def tx_topics(s, d):
    return C.topics(stored_drawers(s, d), "id", "document").select("id", F.array_join("topics", ",").alias("topics"))


def tx_keysent(s, d):
    return stored_drawers(s, d).select("id", F.array_join(X.key_sentences("document"), " | ").alias("sentences"))


def tx_emo(s, d):
    return stored_drawers(s, d).select("id", F.array_join(X.emotions("document"), ",").alias("codes"))


def tx_flag(s, d):
    return stored_drawers(s, d).select("id", F.array_join(X.flags("document"), ",").alias("codes"))


def tx_entdet(s, d):
    return stored_drawers(s, d).select("id", F.array_join(X.capital_codes("document"), ",").alias("codes"))


def _known(s, d):
    return read_table(s, d, "registry").where("code IS NOT NULL AND code <> '' AND name IS NOT NULL")


def tx_comp(s, d):
    return C.compress(stored_drawers(s, d), "id", "document").select("id", "text", "input_len", "output_len", F.round("ratio", 6).alias("ratio"))


def tx_comp_known(s, d):
    """Compression with the codes of the registry."""
    return C.compress(stored_drawers(s, d), "id", "document", _known(s, d)).select("id", "text", "input_len", "output_len", F.round("ratio", 6).alias("ratio"))


def tx_entrep(s, d):
    return C.entity_codes(stored_drawers(s, d), "id", "document", _known(s, d)).select("id", F.array_join("codes", ",").alias("codes"), F.md5("text").alias("text_md5"))


def tx_nonascii(s, d):
    return stored_drawers(s, d).groupBy(X.has_non_ascii("document").alias("non_ascii")).agg(F.count("*").alias("n"))


def win_ctx(s, d):
    """Lines next to which, within two lines, an English pronoun stands."""
    pronoun = rf"(?<![0-9a-z_])(?:{'|'.join(L.PRONOUNS)})(?![0-9a-z_])"
    lines = stored_drawers(s, d).select("id", F.posexplode(F.split(F.lower("document"), "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(-2, 2)
    near = lines.withColumn("near", F.max(F.col("line").rlike(pronoun)).over(w))
    return near.where("near").groupBy("id").agg(F.count("*").alias("n_lines"))


QUERIES = {f.__name__: f for f in (tx_chunk, tx_exch, win_group, tx_convroom, tx_pathroom, tx_id, tx_sent, tx_memory, tx_ents, tx_topics, tx_keysent, tx_emo, tx_flag, tx_entdet, tx_comp, tx_comp_known, tx_entrep, tx_nonascii, win_ctx)}

_EX = f"""ex AS (SELECT id, list_transform(list_filter(list_transform(string_split(document, '> user:'), lambda p, i: {{'i': i, 'p': {sql_trim('p')}}}), lambda x: x.p <> ''), lambda x: CASE WHEN x.i > 1 THEN '> user:' || x.p ELSE x.p END) AS xs FROM d)"""
_SENT = f"""st AS (SELECT id, list_filter(list_transform(regexp_extract_all(document, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS ss FROM d),
 sn AS (SELECT id, unnest(range(len(ss))) AS n, unnest(ss) AS sentence FROM st)"""


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"({i}, '{k.replace(chr(39), chr(39) * 2)}', '{v}')" for i, (k, v) in enumerate(table.items()))


def _codes(table: dict[str, str], most: int) -> str:
    return f"""lx(o, k, v) AS (VALUES {_values(table)}), m AS (SELECT id, v, min(o) AS o FROM d, lx WHERE contains(lower(document), k) GROUP BY id, v QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(o)) <= {most}),
 codes AS (SELECT d.id, coalesce(string_agg(v, ',' ORDER BY v), '') AS codes FROM d LEFT JOIN m ON m.id = d.id GROUP BY d.id)"""


def _room_sum(words: list[str]) -> str:
    return " + ".join(f"(len(lower(document)) - len(replace(lower(document), '{w}', ''))) // {len(w)}" for w in words)


def _rooms() -> str:
    counts = {r: f"({_room_sum(w)})" for r, w in L.CONVERSATION_ROOMS.items()}
    cols = ", ".join(f"{c} AS {r}" for r, c in counts.items())
    best = f"greatest({', '.join(counts)})"
    return f"WITH {D}, c AS (SELECT id, {cols} FROM d) SELECT id, CASE WHEN {best} <= 0 THEN 'general' " + " ".join(f"WHEN {r} = {best} THEN '{r}'" for r in counts) + " END AS room FROM c"


def _marker_score(markers: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(sentence), '{m}') AS INT)" for m in markers)


def _memory() -> str:
    cols = ", ".join(f"({_marker_score(m)}) AS {k}" for k, m in L.MEMORY_MARKERS.items())
    best = f"greatest({', '.join(L.MEMORY_MARKERS)})"
    return f"WITH {D}, {_SENT}, c AS (SELECT id, n, sentence, {cols} FROM sn) SELECT id, n, CASE " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in L.MEMORY_MARKERS) + f" END AS type, {best} AS score, sentence FROM c WHERE {best} > 0"


_KEY = f"""kp AS (SELECT id, list_filter(list_transform(string_split_regex(document, '[.!?\\n]+'), lambda x: {sql_trim('x')}), lambda x: strlen(x) > 10) AS ps FROM d),
 k1 AS (SELECT id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM kp),
 k2 AS (SELECT id, i, p, {" + ".join(f"CAST(contains(lower(p), '{w}') AS INT) * 2" for w in L.DECISION_WORDS)} + CAST(strlen(p) < 80 AS INT) + CAST(strlen(p) < 40 AS INT) - 2 * CAST(strlen(p) > 150 AS INT) AS score FROM k1),
 k3 AS (SELECT id, i, score, CASE WHEN strlen(p) > 55 THEN left(p, 52) || '...' ELSE p END AS p, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM k2 QUALIFY r <= 3)"""
_TOPIC = f"""tw AS (SELECT id, unnest(regexp_extract_all(document, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS w FROM d),
 tf AS (SELECT id, lower(w) AS word, sum(1 + 2 * CAST(regexp_matches(w, '^[A-Z]') AS INT) + 2 * CAST(regexp_matches(w, '[_-]|.[A-Z]') AS INT)) AS weight FROM tw WHERE lower(w) NOT IN {in_list(L.DIALECT_STOP_WORDS)} GROUP BY ALL),
 tt AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS r FROM tf QUALIFY r <= 5),
 topics AS (SELECT d.id, string_agg(word, {{sep}} ORDER BY r) AS topics FROM d LEFT JOIN tt USING (id) GROUP BY d.id)"""
_CAP = f"""cw AS (SELECT id, list_filter(list_transform(list_filter(string_split_regex(document, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]+'), lambda w: w <> '')[2:], lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND lower(w) NOT IN {in_list(L.DIALECT_STOP_WORDS)}) AS ws FROM d),
 cc AS (SELECT id, list_transform(ws, lambda w: upper(left(w, 3))) AS cs FROM cw), ce AS (SELECT id, array_to_string(list_filter(cs, lambda x, i: list_position(cs, x) = i)[1:3], {{sep}}) AS codes FROM cc)"""


def _count(pattern: str, text: str = "document", name: str = "name") -> str:
    parts = "(?i)" + pattern
    pieces = [("'" + p.replace("'", "''") + "'") for p in parts.split("%s")]
    return f"len(regexp_extract_all({text}, concat({f', {name}, '.join(pieces)})))"


def _entity_sql() -> str:
    total = lambda ps: " + ".join(_count(p) for p in ps)
    pron = "(?i)\\b(" + "|".join(L.PRONOUNS) + ")\\b"
    return f"""WITH {D}, w AS (SELECT id, document, regexp_extract_all(document, '\\b[A-Z][a-z]{{1,19}}\\b') AS ws, regexp_extract_all(document, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b') AS cs FROM d),
 c0 AS (SELECT id, document, list_concat(list_filter(ws, lambda w: lower(w) NOT IN {in_list(L.ENTITY_STOP_WORDS)}), cs) AS c FROM w),
 c1 AS (SELECT id, name, count(*) AS freq FROM (SELECT id, unnest(c) AS name FROM c0) GROUP BY ALL),
 ln AS (SELECT id, string_split(lower(document), chr(10)) AS ls FROM d),
 nr AS (SELECT id, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(array_to_string(ls[greatest(i - 2, 1):i + 2], ' '), '{pron}') THEN x END), lambda x: x IS NOT NULL) AS near FROM ln),
 s AS (SELECT id, name, freq, {total(L.DIALOGUE)} AS dia, {total(L.PERSON_VERBS)} AS act, {_count(L.ADDRESSED)} AS adr, {total(L.PROJECT_VERBS)} AS prj, {_count(L.VERSIONED)} AS ver, {_count(L.CODE_REFERENCE)} AS cod,
   len(list_filter(near, lambda x: contains(x, lower(name)))) AS hits FROM c1 JOIN d USING (id) JOIN nr USING (id)),
 p AS (SELECT id, name, freq, 3 * dia + 2 * act + 2 * hits + 4 * adr AS person, 2 * prj + 3 * ver + 3 * cod AS project, CAST(dia > 0 AS INT) + CAST(act > 0 AS INT) + CAST(adr > 0 AS INT) + CAST(hits > 0 AS INT) AS kinds FROM s),
 r AS (SELECT *, CASE WHEN person + project > 0 THEN person / (person + project) END AS ratio FROM p)
 SELECT id, name, freq, person, project,
  CASE WHEN ratio IS NULL THEN 'uncertain' WHEN ratio >= 0.7 AND person >= 2 THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain' WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
  round(CASE WHEN ratio IS NULL THEN least(freq / 50.0, 0.4) WHEN ratio >= 0.7 AND kinds >= 2 AND person >= 2 THEN least(0.5 + ratio * 0.5, 0.99) WHEN ratio >= 0.7 AND person >= 2 THEN least(0.5 + ratio * 0.3, 0.85)
   WHEN ratio >= 0.7 THEN 0.4 WHEN ratio <= 0.3 THEN least(0.5 + (1 - ratio) * 0.5, 0.99) ELSE 0.5 END, 6) AS confidence FROM r"""


_FOLDERS = ", ".join(f"('{w}', '{r}')" for r, ws in L.FOLDER_ROOMS.items() for w in ws.split())
_TRIMMED = sql_trim("text")
SQL = {
    "tx_chunk": f"""WITH t AS (SELECT doc_id, {_TRIMMED} AS text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS ps FROM t),
 f AS (SELECT doc_id, text, list_reduce(list_transform(ps, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x}}), lambda a, b: CASE
   WHEN a.cur <> '' AND strlen(a.cur) + strlen(b.cur) + 2 > 800 THEN {{'done': list_append(a.done, {sql_trim('a.cur')}), 'cur': CASE WHEN strlen({sql_trim('a.cur')}) > 100 THEN right({sql_trim('a.cur')}, 100) || chr(10) || chr(10) || chr(10) || chr(10) || b.cur ELSE b.cur END}}
   ELSE {{'done': a.done, 'cur': CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || b.cur ELSE b.cur END}} END,
   {{'done': CAST([] AS VARCHAR[]), 'cur': ''}}) AS s FROM p),
 c AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN strlen(text) <= 800 THEN [text] WHEN s.cur <> '' THEN list_append(s.done, {sql_trim('s.cur')}) ELSE s.done END AS cs FROM f),
 u AS (SELECT doc_id, unnest(range(len(cs))) AS n, unnest(cs) AS chunk FROM c) SELECT doc_id, n, md5(chunk) AS chunk_md5, strlen(chunk) AS bytes FROM u""",
    "tx_exch": f"WITH {D}, {_EX} SELECT id, unnest(range(len(xs))) AS n, unnest(xs) AS exchange FROM ex",
    "win_group": f"WITH {D}, {_EX}, u AS (SELECT id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM ex) SELECT id, i // 3 AS n, string_agg(x, chr(10) ORDER BY i) AS chunk FROM u GROUP BY ALL",
    "tx_convroom": _rooms(),
    "tx_pathroom": f"""WITH {D}, folders(w, r) AS (VALUES {_FOLDERS}), s AS (SELECT DISTINCT source FROM d WHERE source <> ''), seg AS (SELECT source, unnest(string_split(source, '/')) AS part, unnest(range(len(string_split(source, '/')))) AS i FROM s),
 hit AS (SELECT source, CASE WHEN lower(part) = 'exports' THEN 'exports' ELSE r END AS room, CASE WHEN lower(part) = 'exports' THEN 0 ELSE 1 END AS o, i FROM seg LEFT JOIN folders ON w = lower(part) WHERE lower(part) = 'exports' OR r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, i) = 1)
 SELECT s.source, coalesce(room, 'general') AS room FROM s LEFT JOIN hit USING (source)""",
    "tx_id": f"WITH {D} SELECT seq, id, md5(wing || room || document) AS content_id FROM d",
    "tx_sent": f"WITH {D}, {_SENT} SELECT id, n, sentence FROM sn",
    "tx_memory": _memory(),
    "tx_ents": _entity_sql(),
    "tx_topics": f"WITH {D}, {_TOPIC.replace('{sep}', chr(39) + ',' + chr(39))} SELECT id, coalesce(topics, '') AS topics FROM topics",
    "tx_keysent": f"WITH {D}, {_KEY} SELECT d.id, coalesce(string_agg(p, ' | ' ORDER BY r), '') AS sentences FROM d LEFT JOIN k3 USING (id) GROUP BY d.id",
    "tx_emo": f"WITH {D}, {_codes(L.EMOTIONS, 3)} SELECT id, codes FROM codes",
    "tx_flag": f"WITH {D}, {_codes(L.FLAGS, 5)} SELECT id, codes FROM codes",
    "tx_entdet": f"WITH {D}, {_CAP.replace('{sep}', chr(39) + ',' + chr(39))} SELECT id, codes FROM ce",
    "tx_nonascii": f"WITH {D} SELECT regexp_matches(document, '[^\\x00-\\x7F]') AS non_ascii, count(*) AS n FROM d GROUP BY 1",
    "win_ctx": f"""WITH {D}, l AS (SELECT id, unnest(range(len(string_split(document, chr(10))))) AS n, unnest(string_split(lower(document), chr(10))) AS line FROM d),
 x AS (SELECT id, max(regexp_matches(line, '\\b({'|'.join(L.PRONOUNS)})\\b')) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l) SELECT id, count(*) AS n_lines FROM x WHERE near GROUP BY id""",
}
_SEP = "', '"
SQL["tx_comp"] = f"""WITH {D}, {_TOPIC.replace('{sep}', _SEP)}, {_KEY}, {_CAP.replace('{sep}', _SEP)},
 le(o, k, v) AS (VALUES {_values(L.EMOTIONS)}), lf(o, k, v) AS (VALUES {_values(L.FLAGS)}),
 em AS (SELECT id, string_agg(v, ', ' ORDER BY v) AS emo FROM (SELECT id, v FROM d, le WHERE contains(lower(document), k) GROUP BY id, v QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(o)) <= 3) GROUP BY id),
 fm AS (SELECT id, string_agg(v, ', ' ORDER BY v) AS flg FROM (SELECT id, v FROM d, lf WHERE contains(lower(document), k) GROUP BY id, v QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(o)) <= 5) GROUP BY id),
 ks AS (SELECT id, string_agg(p, chr(10) ORDER BY r) AS sents FROM k3 GROUP BY id),
 o AS (SELECT d.id, strlen(document) AS input_len, concat_ws(chr(10), CASE WHEN coalesce(topics, '') <> '' THEN '[T: ' || topics || ']' END, '[E: ' || emo || ']', '[F: ' || flg || ']', CASE WHEN codes <> '' THEN '[ENT: ' || codes || ']' END, sents) AS text
  FROM d LEFT JOIN topics USING (id) LEFT JOIN em USING (id) LEFT JOIN fm USING (id) LEFT JOIN ce USING (id) LEFT JOIN ks USING (id) WHERE {sql_trim('document')} <> '')
 SELECT id, text, input_len, strlen(text) AS output_len, round(CASE WHEN strlen(text) > 0 THEN input_len / strlen(text) ELSE 0 END, 6) AS ratio FROM o"""
_KNOWN = """kn AS (SELECT name, min(code) AS code FROM registry WHERE code IS NOT NULL AND code <> '' AND name <> lower(name) GROUP BY name),
 kf AS (SELECT d.id, list({'n': name, 'c': code} ORDER BY length(name) DESC, name, code) AS ns, list_sort(list_distinct(list(code))) AS cs FROM d, kn WHERE contains(lower(document), lower(name)) GROUP BY d.id),
 kr AS (SELECT d.*, coalesce(cs, []) AS cs, CASE WHEN ns IS NULL THEN document ELSE list_reduce(list_transform(ns, lambda x: {'t': document, 'n': x.n, 'c': x.c}), lambda a, b: {'t': replace(a.t, b.n, b.c), 'n': b.n, 'c': b.c}, {'t': document, 'n': '', 'c': ''}).t END AS working FROM d LEFT JOIN kf ON kf.id = d.id)"""
SQL["tx_entrep"] = f"WITH {D}, {_KNOWN} SELECT id, array_to_string(cs, ',') AS codes, md5(working) AS text_md5 FROM kr"
_COMP = SQL["tx_comp"].replace(f"WITH {D},", f"WITH {D}, {_KNOWN},", 1).replace("string_split_regex(document, '[.!?\\n]+')", "string_split_regex(working, '[.!?\\n]+')").replace("AS ps FROM d)", "AS ps FROM kr)")
SQL["tx_comp_known"] = _COMP.replace("ce AS (SELECT id, array_to_string(", "ce AS (SELECT cc.id, CASE WHEN len(kr.cs) > 0 THEN array_to_string(kr.cs, ', ') ELSE array_to_string(", 1).replace("[1:3], ', ') AS codes FROM cc)", "[1:3], ', ') END AS codes FROM cc JOIN kr ON kr.id = cc.id)", 1).replace("list_filter(cs, lambda x, i: list_position(cs, x) = i)", "list_filter(cc.cs, lambda x, i: list_position(cc.cs, x) = i)", 1)
