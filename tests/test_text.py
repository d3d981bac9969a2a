import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.functions.porter import stem, stemmed_tokens
from memlake.operators import dialect as C
from memlake.operators import retrieval as R


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def python_chunks(text, size=800, overlap=100):
    text = text.strip()
    if not text:
        return []
    if len(text.encode()) <= size:
        return [text]
    done, cur = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if cur and len(cur.encode()) + len(p.encode()) + 2 > size:
            done.append(cur.strip())
            cur = done[-1][-overlap:] + "\n\n" if len(done[-1].encode()) > overlap else ""
        cur = cur + "\n\n" + p if cur else p
    return done + ([cur.strip()] if cur else [])


@pytest.mark.parametrize("text", ["", "  \n ", "short", "x" * 800, "x" * 801, "\n\n".join(["word " * 50] * 4), "\n\n".join(["word " * 100] * 3), "é" * 500 + "\n\n" + "ü" * 500, "a" * 2000 + "\n\nb"])
def test_chunks(spark, text):
    assert one(spark, X.chunks("x"), text) == python_chunks(text)


def test_chunks_of_null(spark):
    assert one(spark, X.chunks("x"), None) is None


def test_exchanges_and_groups(spark):
    t = "intro\n> user: a\nassistant: b\n> user: c\n> user:  "
    assert one(spark, X.exchanges("x"), t) == ["intro", "> user:a\nassistant: b", "> user:c"]
    assert one(spark, X.grouped(X.exchanges("x"), 2), t) == ["intro\n> user:a\nassistant: b", "> user:c"]
    assert one(spark, X.grouped(X.exchanges("x"), 2), "") == []


@pytest.mark.parametrize(("text", "room"), [("the database schema and SQL", "database"), ("React component with CSS", "frontend"), ("docker pipeline", "devops"), ("nothing here", "general"), ("bug", "debugging")])
def test_conversation_room(spark, text, room):
    assert one(spark, X.conversation_room("x"), text) == room


@pytest.mark.parametrize(("path", "room"), [("src/UI/x.ts", "frontend"), ("docs/a.md", "documentation"), ("API", "backend"), ("x/y.z", "general"), ("x/Billing/docs", "Billing")])
def test_path_room(spark, path, room):
    assert one(spark, X.path_room("x", ["Billing"]), path) == room


def test_sentences_and_memories(spark):
    assert one(spark, X.sentences("x"), "We use v2.0 now! Ok? tail") == ["We use v2.", "0 now!", "Ok?", "tail"]
    df = spark.createDataFrame([(1, "We decided to ship."), (2, "I like tea."), (3, "nothing"), (4, "The bug and the error: fix"), (5, None), (6, "")], "k int, s string")
    assert {(r.k, r.type, r.score) for r in C.memories(df, "s").collect()} == {(1, "decision", 1), (2, "preference", 1), (4, "problem", 3)}


@pytest.mark.parametrize(("q", "kind"), [("Can you suggest a book", "PREFERENCE"), ("what did i do on monday", "TEMPORAL"), ("who gave me Chicago", "TEMPORAL"), ("what degree", "FACT"), ("日本", "PREFERENCE")])
def test_classify(spark, q, kind):
    assert one(spark, X.classify_query("x"), q) == kind


def test_keywords_and_terms(spark):
    assert one(spark, X.keywords("x"), "What was the GraphQL API api decision?") == ["graphql", "api", "decision"]
    assert one(spark, X.query_terms("x"), "what is it") == ["what", "is", "it"]
    assert one(spark, X.query_terms("x"), "The foo_bar can't") == ["foo_bar"]
    assert one(spark, X.keyword_overlap(X.keywords("x"), F.lit("an API design")), "api zebra") == 0.5


def test_compress(spark):
    df = spark.createDataFrame([(1, "We decided to use Postgres because Alice prefers it. The API was broken and Alice was worried."), (2, "  "), (3, None)], "k int, t string")
    rows = C.compress(df, "k", "t").collect()
    assert [r.k for r in rows] == [1]
    assert rows[0].text.startswith("[T: alice") and "[E: " in rows[0].text and "[F: DECISION" in rows[0].text and "[ENT: POS, ALI, API]" not in rows[0].text
    assert rows[0].input_len == 94


def test_entity_codes(spark):
    docs = spark.createDataFrame([(1, "Alice Smith met alice smith and Bob"), (2, "nobody"), (3, None)], "k int, t string")
    known = spark.createDataFrame([("Alice Smith", "ALS"), ("Alice", "ALI"), ("bob", "B")], "name string, code string")
    got = {r.k: (r.text, r.codes) for r in C.entity_codes(docs, "k", "t", known).collect()}
    assert got == {1: ("ALS met alice smith and Bob", ["ALI", "ALS"]), 2: ("nobody", []), 3: (None, [])}


WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running database generalizations oscillators".split()


def fts(texts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(texts, 1))
    return db


def test_porter_as_sqlite():
    db = fts(WORDS)
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    got = dict(db.execute("SELECT doc, term FROM v"))
    assert {w: stem(w) for w in WORDS} == {w: got[i] for i, w in enumerate(WORDS, 1)}


def test_bm25_as_sqlite(spark):
    texts = ["GraphQL API design with running servers", "React front end", "PostgreSQL database API running runs", "api api api design", "Café crème and foo bar", "bar foo unrelated", "the server design of the café"]
    queries = ["GraphQL API", "design design run", "foo_bar", "cafe", "the of", "zzz", ""]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {(r.query_id, r.id): r.rank for r in R.bm25_scores(docs, asked, stemmed_tokens).collect()}
    db, want = fts(texts), {}
    for i, q in enumerate(queries):
        terms = one(spark, X.query_terms("x"), q)
        match = " OR ".join(f'"{t}"' for t in terms if t)
        if match:
            want |= {(i, d): r for d, r in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_nulls_filter_and_ties(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha beta", "b"), (3, None, "a"), (4, "", "a"), (5, "gamma delta eps", "a")], "id long, text string, wing string")
    asked = spark.createDataFrame([(1, "alpha"), (2, None), (3, "nothing")], "query_id int, query string")
    assert [(r.query_id, r.id, r.position) for r in R.bm25(docs, asked).orderBy("position").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert [r.id for r in R.bm25(docs, asked, where=F.col("wing") == "b").collect()] == [2]
    assert R.bm25(docs.limit(0), asked).count() == 0


def test_vector_search(spark):
    a, b, c = [1.0] * 8, [1.0] * 7 + [0.5], [-1.0] * 8
    v = spark.createDataFrame([("a", a), ("b", b), ("c", c), ("z", [0.0] * 8), ("n", None)], "id string, vector array<float>")
    q = spark.createDataFrame([(1, a), (2, None)], "query_id int, vector array<float>")
    got = R.vector_search(v, q, 4).orderBy("position").collect()
    assert [r.id for r in got] == ["a", "b", "z", "c"] and abs(got[0].similarity - 1) < 1e-6 and got[2].similarity == 0
    assert [r.id for r in R.vector_search(v, q, 1).collect()] == ["a"]
    with pytest.raises(Exception, match="dimensions"):
        R.vector_search(v, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>"), 1).collect()


def test_fusion_is_symmetric_under_equal_weights(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, position int")
    sem = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, position int")
    x = [(r.id, r.score) for r in R.fuse(lex, sem, 3, 1.0, 1.0).orderBy("position").collect()]
    assert x == [(r.id, r.score) for r in R.fuse(sem, lex, 3, 1.0, 1.0).orderBy("position").collect()]
    assert x[0][0] == "b" and abs(x[0][1] - (1 / 61 + 1 / 62)) < 1e-9
    assert R.fuse(lex, sem.limit(0), 0).count() == 2


def test_hybrid_signs(spark):
    docs = spark.createDataFrame([(1, "graphql api decision made"), (2, "graphql other words here")] + [(i, "filler text number") for i in range(3, 9)], "id long, text string")
    q = spark.createDataFrame([(1, "GraphQL API decision")], "query_id int, query string")
    literal, corrected = (R.hybrid(docs, q, 2, b).orderBy("position").collect() for b in ("literal", "corrected"))
    assert literal[0].id == corrected[0].id == 1
    assert corrected[0].boosted < corrected[0].rank < literal[0].boosted
    assert re.match("^-", str(literal[0].rank))


def test_filters_hold_for_every_search(spark):
    docs = spark.createDataFrame([(i, f"running api designs {i}", "a" if i % 2 else "b") for i in range(8)], "id long, text string, wing string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "a" if i % 2 else "b") for i in range(8)], "id long, vector array<double>, wing string")
    asked = spark.createDataFrame([("q", "run api design", [1.0, 7.0]), ("p", "what do I prefer", [1.0, 2.0])], "query_id string, query string, vector array<double>")
    odd = F.col("wing") == "a"
    plain = vectors.select("id", "vector")
    for hits in (R.vector_search(vectors, asked, 9, odd), R.hybrid(docs, asked, 9, where=odd), R.fused(docs, plain, asked, 9, odd), R.smart(docs, plain, asked, 9, odd)):
        got = [r.id for r in hits.where("query_id = 'q'").collect()]
        assert sorted(got) == [1, 3, 5, 7]


def test_search_stems_by_default(spark):
    docs = spark.createDataFrame([(1, "she was running"), (2, "no match")], "id long, text string")
    asked = spark.createDataFrame([("q", "runs")], "query_id string, query string")
    assert [r.id for r in R.bm25(docs, asked).collect()] == [1] and R.bm25(docs, asked, analyze=X.tokens).count() == 0


def test_topics_and_codes_with_repeated_and_clashing_rows(spark):
    from memlake.operators import dialect as C

    df = spark.createDataFrame([(1, "Alice Zed likes Graphql graphql. We decided because Alice Zed said so."), (2, ""), (3, None)], "id long, text string")
    twice = df.union(df)
    assert [tuple(r.topics[:1]) for r in C.topics(twice, "id", "text").where("id = 1").collect()] == [("alice",)] * 2
    known = spark.createDataFrame([("Alice Zed", "ALZ"), ("alice", "X")], "name string, code string")
    got = C.compress(df, "id", "text", known).collect()
    assert len(got) == 1 and "[ENT: ALZ]" in got[0].text and "We decided because ALZ said so" in got[0].text
    assert "[ENT: ZED" in C.compress(df, "id", "text").first().text
