import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions.embedding import HashingEmbedder, WordPiece, choose_embedder, embed_column, mean_pool
from memlake.operators import evaluation as V
from memlake.operators import index as I
from memlake.operators import layers
from memlake.operators import retrieval as R
from memlake.operators import store as S
from memlake.plans.service import Service
from memlake.plans.source_queries import src_project
from memlake.sources import files as S2
from memlake.sources.exports import transcripts
from memlake.streaming.ingest import SCHEMA, drop_folder, ingest, windowed_counts

TREE = {
    "mapping": {
        "r": {"message": None, "children": ["a"], "parent": None},
        "a": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi", 3, " "]}}, "children": ["b", "c"], "parent": "r"},
        "b": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["one"]}}, "children": [], "parent": "a"},
        "c": {"message": {"author": {"role": "tool"}, "content": {"parts": ["no"]}}, "children": ["d"], "parent": "a"},
        "d": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["two"]}}, "children": ["a"], "parent": "c"},
    }
}
CASES = {
    "roles.json": (json.dumps([{"role": "user", "content": "q"}, {"role": "", "content": "x"}, {"role": "assistant", "content": "a"}]), "> user: q\nassistant: a"),
    "slack.json": (json.dumps([{"user": "ann", "text": "hi"}, {"text": "yo"}, {"user": "bob", "text": ""}]), "ann: hi\nunknown: yo"),
    "tree.json": (json.dumps(TREE), "> user: hi\nassistant: one\nassistant: two"),
    "lines.JSONL": ('{"role":"user","content":"q"}\nbroken\n\n{"content":"no role"}\n{"role":"assistant","content":"a"}', "> user: q\nassistant: a"),
    "list.json": ('[{"role":"user","content":["q"]}]', '[{"role":"user","content":["q"]}]'),
    "no.json": ("not json", "not json"),
    "t.txt": ("  some text \n", "some text"),
    "e.json": ("  ", ""),
    "n.txt": (None, ""),
    "x.py": (" code ", " code "),
}


def test_transcripts(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "path string, content string")
    assert {r.path: r.transcript for r in transcripts(df).collect()} == {k: v[1] for k, v in CASES.items()}


def test_project_walk(spark, tmp_path):
    for p, t in {"src/ui/a.ts": "hello", "docs/b.md": "para\n\n" * 3, "node_modules/x.js": "no", ".hidden/y.txt": "no", "pic.png": "no", "memlake.yaml": "wing: w\nrooms:\n- name: src\n", "empty.txt": " ", "store/z.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    cfg = S2.read_project_config(str(tmp_path / "memlake.yaml"))
    files = S2.walk_project(spark, str(tmp_path), skip="store")
    got = {(r.source, r.wing, r.room) for r in S2.project_drawers(files, cfg, "2026-01-01").collect()}
    assert got == {("src/ui/a.ts", "w", "src"), ("docs/b.md", "w", "documentation")}
    with pytest.raises(OSError):
        S2.read_project_config(str(tmp_path / "missing.yaml"))


def test_project_query_takes_all_documents(spark, tmp_path):
    rows = [(1, "src/a.py", "one"), (2, "chats/b.json", "two"), (3, "c.JSONL", "three"), (4, None, "four"), (5, "", "five"), (6, "node_modules/x.js", "six"), (7, ".hidden/y", "seven"), (8, "z.md", " ")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.bytes for r in src_project(spark, str(tmp_path)).collect()) == [3, 3, 4, 4, 5]


def test_conversation_walk_store_and_reingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(CASES["roles.json"][0])
    (tmp_path / "in/b.txt").write_text("> user: deploy docker\nassistant: ok\n> user: deploy docker\nassistant: ok")
    (tmp_path / "in/c.bin").write_text("no")
    d = S2.conversation_drawers(S2.walk_conversations(spark, str(tmp_path / "in")), "chats", "2026-01-01")
    assert sorted((r.room, r.source) for r in d.collect()) == [("devops", "b.txt"), ("general", "a.json")]
    numbered = d.withColumn("seq", F.monotonically_increasing_id())
    store = S.insert(numbered, numbered)
    assert store.count() == 2
    S2.write_store(store, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("wing = 'chats'").count() == 2


def test_config(tmp_path, monkeypatch):
    monkeypatch.delenv("MEMLAKE_STORE_PATH", raising=False)
    cfg = S2.AppConfig.load(str(tmp_path))
    assert cfg.store_path == str(tmp_path / "store")
    cfg.store_path = "/elsewhere"
    cfg.save(str(tmp_path))
    assert S2.AppConfig.load(str(tmp_path)).store_path == "/elsewhere"
    monkeypatch.setenv("MEMLAKE_STORE_PATH", "/env")
    assert S2.AppConfig.load(str(tmp_path)).store_path == "/env"
    (tmp_path / "config.json").write_text("{broken")
    assert S2.AppConfig.load(str(tmp_path)).store_path == "/env"


def test_registry_file(spark, tmp_path):
    assert S2.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    entries = [{"name": "Kai", "type": "person", "aliases": ["K", "Kaito"], "source": "onboarding", "code": "KAI"}, {"name": "Depot", "type": "project", "aliases": None, "source": "learned", "code": ""}]
    (tmp_path / "r.json").write_text(json.dumps({"entities": entries}, indent=2))
    r = S2.read_registry(spark, str(tmp_path / "r.json"))
    assert [(x.ord, x.name, x.aliases) for x in r.orderBy("ord").collect()] == [(0, "Kai", ["K", "Kaito"]), (1, "Depot", None)]
    S2.write_registry(r, str(tmp_path / "out.json"))
    text = "".join(f.read_text() for f in (tmp_path / "out.json").glob("part-*"))
    assert json.loads(text) == {"entities": [entries[0], {**entries[1], "aliases": []}]} and text.startswith("{\n")
    assert S2.read_registry(spark, str(tmp_path / "out.json")).count() == 2
    S2.write_registry(r.limit(0), str(tmp_path / "empty.json"))
    assert S2.read_registry(spark, str(tmp_path / "empty.json")).count() == 0


QUESTIONS = [
    {"question_id": "q1", "question_type": "single", "question": "running api designs", "answer": "x", "answer_session_ids": ["s2"], "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["d1", "d2"], "haystack_sessions": [[{"role": "user", "content": "cats"}], [{"role": "user", "content": "the api design"}, {"role": "user", "content": "runs"}, {"role": "assistant", "content": "cats"}]]},
    {"question_id": "q2", "question_type": "multi", "question": "cats", "answer_session_ids": ["none"], "haystack_session_ids": ["s1", "s3"], "haystack_sessions": [[{"role": "user", "content": "cats"}], [{"role": "assistant", "content": "cats"}]]},
]


def test_evaluation_per_haystack(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS))
    m = S2.read_questions(spark, str(tmp_path / "q.json"))
    assert {(r.question_type, r.answer, r.date) for r in m.where("query_id = 'q1' AND session = 's2'").collect()} == {("single", "x", "d2")}
    embed = lambda c: embed_column(HashingEmbedder(256), c)
    for mode in V.MODES:
        got = {r.query_id: (r.question_type, r.rank, r.found_at_5) for r in V.evaluate(m, mode, embed).collect()}
        assert got["q1"][0] == "single" and got["q1"][1] >= 1 and got["q1"][2] == 1 and got["q2"] == ("multi", -1, 0), mode
    assert V.evaluate(m, "smart").count() == 2 and V.evaluate(m.limit(0)).count() == 0
    with pytest.raises(ValueError):
        V.evaluate(m, "other")
    S2.write_results(V.evaluate(m), str(tmp_path / "out"), 1.4)
    rows = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows.columns == ["question_id", "question_type", "found_at_5", "found_at_10", "rank", "latency_ms"]
    assert sorted(tuple(r) for r in rows.collect()) == [("q1", "single", "true", "true", "1", "1"), ("q2", "multi", "false", "false", "-1", "1")]


def test_statistics_of_a_haystack_are_its_own(spark):
    docs = spark.createDataFrame([("g", 1, "alpha beta"), ("g", 2, "gamma"), ("h", 1, "alpha alpha"), ("h", 3, "delta words here")], "grp string, id long, text string")
    asked = spark.createDataFrame([("q", "alpha", "g"), ("p", "alpha", "h")], "query_id string, query string, grp string")
    got = {(r.query_id, r.id): round(r.rank, 9) for r in R.bm25_scores(docs, asked, group="grp").collect()}
    for q, g in (("q", "g"), ("p", "h")):
        one = {(r.query_id, r.id): round(r.rank, 9) for r in R.bm25_scores(docs.where(F.col("grp") == g), asked.where(F.col("query_id") == q)).collect()}
        assert {k: v for k, v in got.items() if k[0] == q} == one and len(one) == 1


def test_store_with_vectors_and_facts(spark, tmp_path):
    store, vec = str(tmp_path / "d"), str(tmp_path / "v")
    assert S2.open_store(spark, store).count() == 0 and S2.open_vectors(spark, vec).count() == 0
    files = spark.createDataFrame([("a.md", "alpha"), ("b.md", "beta"), ("c.md", None)], "path string, content string")
    mined = lambda f: S2.project_drawers(f, S2.ProjectConfig("w"), "2026-01-01")
    embed = lambda c: embed_column(HashingEmbedder(8), c)
    S2.mine_with_vectors(mined(files), embed, store, vec)
    S2.mine_with_vectors(mined(files.union(spark.createDataFrame([("d.md", "delta")], files.schema))), embed, store, vec)
    drawers, vectors = S2.open_store(spark, store), S2.open_vectors(spark, vec)
    assert sorted(r.document for r in drawers.collect()) == ["alpha", "beta", "delta"] and drawers.select("seq").distinct().count() == 3
    assert sorted(r.id for r in vectors.collect()) == sorted(r.id for r in drawers.collect())
    facts = str(tmp_path / "kg")
    assert [x.count() for x in S2.open_facts(spark, facts)] == [0, 0]
    e = spark.createDataFrame([(1, "Alice")], "id long, name string")
    t = spark.createDataFrame([(1, 1, "knows", "Bob", "2026-01-01", "")], "id long, subject_id long, predicate string, object string, valid_from string, valid_to string")
    S2.save_facts(e, t.limit(0), facts)
    S2.save_facts(e, t, facts)
    e2, t2 = S2.open_facts(spark, facts)
    assert e2.collect() == e.collect() and t2.collect() == t.collect()


def test_index_follows_changes(spark, tmp_path):
    texts = [(i, f"the running dog number{i % 5} foo bar" if i % 2 else f"dogs ran foo_bar number{i % 7}") for i in range(30)] + [(99, ""), (100, None)]
    docs = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([("a", "run dogs"), ("b", "foo_bar number3"), ("c", "nothing")], "query_id string, query string")
    rows = lambda df: {(r.query_id, r.id): round(r.rank, 9) for r in df.collect()}
    index = I.upsert(I.insert(I.build(docs.where("id < 10")), docs), docs.where("id % 4 = 0"))
    assert rows(I.scores(index, asked)) == rows(R.bm25_scores(docs, asked)) and len(rows(I.scores(index, asked))) > 30
    index = I.delete(index, docs.where("id < 20").select("id"))
    I.save(index, str(tmp_path / "ix"))
    kept = I.open_index(spark, str(tmp_path / "ix"))
    assert rows(I.scores(kept, asked)) == rows(R.bm25_scores(docs.where("id >= 20"), asked))
    got = I.search(kept, asked, 2, F.col("id") % 2 == 0, docs).collect()
    assert all(r.id % 2 == 0 and r.position <= 2 for r in got)


def test_layers(spark, tmp_path):
    d = S.drawers(spark.createDataFrame([(1, "a", "alpha beta", "w", "r", "", "", ""), (2, "b", "gamma", "v", "r", "", "", "")], SCHEMA))
    assert layers.wake_up(d, str(tmp_path)).first().text == "\n\nPalace has 2 memories across 2 wings and 1 rooms.\nWings: v (1), w (1)"
    (tmp_path / "identity.txt").write_text(" I am. \n")
    assert layers.wake_up(d.limit(0), str(tmp_path)).first().text == "I am.\n\n" + layers.EMPTY
    assert [r.id for r in layers.recall(d, "w").collect()] == ["a"]
    assert [r.id for r in layers.search(d, "gamma").collect()] == ["b"]


def test_embedding(spark):
    df = spark.createDataFrame([("alpha beta gamma",), (None,), ("",)], "t string")
    rows = df.select(embed_column(HashingEmbedder(16), F.col("t")).alias("v")).collect()
    assert abs(np.linalg.norm(rows[0].v) - 1) < 1e-6 and rows[1].v is None and not any(rows[2].v)

    class Broken:
        def embed(self, texts):
            raise OSError

    assert isinstance(choose_embedder(Broken(), HashingEmbedder()), HashingEmbedder) and choose_embedder(Broken()) is None
    pooled = mean_pool(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(pooled, [[0.6, 0.8]])


def test_wordpiece():
    vocab = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##able", "able", ",", "é"])}
    t = WordPiece(vocab)
    assert t.pieces("Unable, able xyz É") == [4, 5, 7, 6, 1, 8]
    ids, mask = t.encode(["able " * 10], 5)
    assert ids.tolist() == [[2, 6, 6, 6, 3]] and mask.tolist() == [[1] * 5]


def test_service(spark):
    d = S.drawers(spark.createDataFrame([(1, "a", "graphql api", "w", "r", "f", "", ""), (2, "b", "other words", "v", "r", "f", "", "")], SCHEMA))
    e = spark.createDataFrame([(1, "Alice")], "id long, name string")
    t = spark.createDataFrame([(1, 1, "knows", "Bob", "2026-01-01", "")], "id long, subject_id long, predicate string, object string, valid_from string, valid_to string")
    s = Service(spark, d, e, t, clock=lambda: datetime(2026, 5, 1, tzinfo=UTC))
    call = lambda m, **p: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p})))
    rows = lambda name, **a: json.loads(call("tools/call", name=name, arguments=a)["result"]["content"][0]["text"])["rows"]
    assert len(call("tools/list")["result"]["tools"]) == 9 and len(Service(spark, d).tools()) == 6
    assert rows("status")[0] == {"wings": 2, "rooms": 2, "drawers": 2, "connections": 1, "kg_entities": 1, "kg_triples": 1}
    assert [r["id"] for r in rows("search", query="graphql")] == ["a"]
    assert rows("add_drawer", id="c", document="x", wing="w", room="r") == [{"status": "ok", "id": "c"}]
    assert call("tools/call", name="add_drawer", arguments={"id": "c", "document": "x", "wing": "w", "room": "r"})["result"]["isError"]
    assert rows("list_rooms", wing="w") == [{"name": "r", "drawers": 2}]
    assert rows("delete_drawer", id="c") and rows("list_wings") == [{"name": "v", "drawers": 1}, {"name": "w", "drawers": 1}]
    assert rows("kg_add", subject="Zoe", predicate="likes", object="tea")[0]["valid_from"] == "2026-05-01"
    assert rows("kg_query", subject="Zoe")[0]["object"] == "tea" and rows("kg_query", subject="Alice")[0]["object"] == "Bob"
    assert {r["id"] for r in rows("traverse_graph", start_room="w/r")} == {"a", "b"}
    assert call("nope")["error"]["code"] == -32601 and json.loads(s.handle("{"))["error"]["code"] == -32700
    assert s.handle('{"method": "notifications/initialized"}') is None
    assert call("tools/call", name="search", arguments={})["result"]["isError"]


def test_service_returns_all_rows_of_a_large_result(spark):
    d = S.drawers(spark.createDataFrame([(1, "a", "x", "w", "r", "f", "", "")], SCHEMA))
    e = spark.createDataFrame([(1, "Alice")], "id long, name string")
    t = spark.range(2500).selectExpr("id", "1L AS subject_id", "'knows' AS predicate", "concat('p', id % 2400) AS object", "'2026-01-01' AS valid_from", "'' AS valid_to")
    s = Service(spark, d, e, t)
    call = lambda **a: json.loads(json.loads(s.handle(json.dumps({"id": 1, "method": "tools/call", "params": {"name": "kg_query", "arguments": a}})))["result"]["content"][0]["text"])
    pages = [call(subject="Alice")]
    s.triples = t.limit(0)
    while "next" in pages[-1]:
        pages.append(call(next=pages[-1]["next"]))
    objects = [r["object"] for p in pages for r in p["rows"]]
    assert [len(p["rows"]) for p in pages] == [1000, 1000, 500] and {p["count"] for p in pages} == {2500}
    assert objects == sorted(f"p{i % 2400}" for i in range(2500))


def test_streaming_ingest(spark, tmp_path):
    rows = [(1, "a", "one", "w", "r", "", "", ""), (2, "a", "two", "w", "r", "", "", ""), (3, None, "x", "w", "r", "", "", "")]
    (tmp_path / "in").mkdir()

    def step(items):
        spark.createDataFrame(items, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(drop_folder(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
        return {r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()}

    assert step(rows) == {"a"}
    assert step([(4, "a", "again", "w", "r", "", "", ""), (5, "b", "new", "w", "r", "", "", "")]) == {"a", "b"}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_windowed_counts(spark):
    m = spark.createDataFrame([(datetime(2026, 1, 1, 3), "user"), (datetime(2026, 1, 1, 4), "user"), (datetime(2026, 1, 2), "user")], "at timestamp, role string")
    assert sorted(r.n for r in windowed_counts(m, "at").collect()) == [1, 2]
