import os

from pyspark.sql import functions as F

from memlake.operators import entities as E
from memlake.operators import graph as G
from memlake.operators import store as S
from memlake.operators.components import connected_components

COLS = "seq long, id string, document string, wing string, room string, source string, filed_at string, hall string"


def rows(spark, *items):
    return spark.createDataFrame([(i, *x, *[None] * (7 - len(x))) for i, x in enumerate(items)], COLS)


def test_first_writer_and_nulls(spark):
    d = S.drawers(rows(spark, ("a", "one", "w", "r"), ("a", "two", "w", "r"), (None, "lost", "w", "r"), ("b", None, "w", "r")))
    assert {(r.id, r.document, r.hall) for r in d.collect()} == {("a", "one", ""), ("b", "", "")}


def test_insert_upsert_delete(spark):
    store = S.drawers(rows(spark, ("a", "one", "w", "r"), ("b", "two", "w", "r")))
    new = rows(spark, ("b", "changed", "w", "r"), ("c", "three", "w", "r"), ("c", "again", "w", "r"))
    new = new.select(store.columns).withColumn("seq", F.col("seq") + 10)
    assert {(r.id, r.document) for r in S.insert(store, new).collect()} == {("a", "one"), ("b", "two"), ("c", "three")}
    assert {(r.id, r.document, r.seq) for r in S.upsert(store, new).collect()} == {("a", "one", 0), ("b", "changed", 1), ("c", "again", 12)}
    gone = spark.createDataFrame([("a",), ("zz",), (None,)], "id string")
    assert [r.id for r in S.delete(store, gone).collect()] == ["b"]
    assert S.delete(store, gone.limit(0)).count() == 2


def test_get_page(spark):
    store = S.drawers(rows(spark, *[(f"d{i}", "x", "w" if i % 2 else "v", "r") for i in range(10)]))
    assert [r.seq for r in S.get(store, S.Query(wing="w", limit=2, offset=1)).collect()] == [3, 5]
    assert S.get(store, S.Query()).count() == 10


def test_entities_get_or_create(spark):
    e = spark.createDataFrame([(1, "Alice"), (5, "Bob")], "id long, name string")
    names = spark.createDataFrame([("Bob",), ("Carol",), ("Abe",), ("Carol",), (None,)], "name string")
    assert {(r.id, r.name) for r in S.add_entities(e, names).collect()} == {(1, "Alice"), (5, "Bob"), (6, "Abe"), (7, "Carol")}


def test_invalidate(spark):
    t = spark.createDataFrame([(1, 1, "works_at", "Acme", "2026-01-01", ""), (2, 1, "works_at", "Acme", "2025-01-01", "2025-02-01"), (3, 2, "works_at", "Acme", "x", None)], "id long, subject_id long, predicate string, object string, valid_from string, valid_to string")
    f = spark.createDataFrame([(1, "works_at", "Acme")], "subject_id long, predicate string, object string")
    assert {(r.id, r.valid_to) for r in S.invalidate(t, f, "2026-06-01").collect()} == {(1, "2026-06-01"), (2, "2025-02-01"), (3, "")}


def test_fact_store_scenario(spark):
    e = spark.createDataFrame([(1, "Alice")], "id long, name string")
    t = spark.createDataFrame([(1, 1, "works_at", "Acme", "2026-01-01", "2026-06-01"), (2, 1, "works_at", "NewCo", "2026-06-01", None)], "id long, subject_id long, predicate string, object string, valid_from string, valid_to string")
    at = lambda d: [r.object for r in G.facts_at(e, t, d, "Alice").collect()]
    assert at("2026-03-01") == ["Acme"] and at("2026-06-01") == ["NewCo"] and at("2025-01-01") == []
    assert [r.object for r in G.timeline(e, t, "Alice").collect()] == ["Acme", "NewCo"]
    assert [r.object for r in G.active_facts(e, t, "Alice").collect()] == ["NewCo"]


def test_room_graph_scenario(spark):
    d = S.drawers(rows(spark, ("1", "a", "w1", "backend", "shared.py"), ("2", "b", "w2", "backend", "shared.py"), ("3", "c", "w1", "docs", None)))
    assert {(r.src, r.dst) for r in G.room_edges(d).collect()} == {("w1/backend", "w2/backend"), ("w2/backend", "w1/backend")}
    assert [r.room for r in G.tunnels(d, "w1", "w2").collect()] == ["backend"]
    assert tuple(G.palace_stats(d).first()) == (2, 3, 3, 1)
    assert {r.id for r in G.traverse(d, "w1/backend", 2).collect()} == {"1", "2"}
    assert G.traverse(d, "nowhere", 2).count() == 0
    sizes = [G.traverse(d, "w1/backend", k).count() for k in range(3)]
    assert sizes == sorted(sizes)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registry(spark):
    schema = "ord long, name string, type string, aliases array<string>, source string, code string"
    r = spark.createDataFrame([(1, "Alice Smith", "person", ["Ali"], "s", "ALI"), (2, "ali", "person", None, "s", None), (3, "Bob", None, [None], "s", "B")], schema)
    found = {x.name: x.entry_ord for x in E.lookup(r, spark.createDataFrame([("ALI",), ("bob",), ("nobody",), (None,)], "name string")).collect()}
    assert found == {"ALI": 1, "bob": 3, "nobody": None, None: None}
    new = spark.createDataFrame([(10, "ALI", "p", [], "s", ""), (11, "Carol", "p", [], "s", ""), (12, "carol", "p", [], "s", "")], schema)
    ok, rejected = E.register(r, new)
    assert sorted(x.ord for x in ok.collect()) == [1, 2, 3, 11] and sorted(x.ord for x in rejected.collect()) == [10, 12]


def test_detect_entities(spark):
    text = "Alice said hello. Alice asked Bob.\nShe laughed.\nhey Bob thanks Bob\nwe deployed Zephyr and import Zephyr, Zephyr-core Zephyr.py\nHarvest went well"
    got = {r.name: r for r in E.detect_entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string"), "k", "t").collect()}
    assert got["Alice"].type == "person" and got["Bob"].type == "person" and got["Zephyr"].type == "project"
    assert "She" not in got and got["Harvest"].type in ("uncertain", "person")


def test_drawers_ignore_extra_columns(spark):
    raw = rows(spark, ("a", "x", "w", "r")).withColumns({"first": F.lit(1), "n": F.lit(2), "rank": F.lit(3)})
    assert S.drawers(raw).columns == ["seq", *S.DRAWER]


def test_scratch_deletes_its_own_tables_only(spark):
    from memlake.runtime import scratch, written

    outer = written(spark.range(3))
    with scratch(spark):
        inner = written(spark.range(4))
        with scratch(spark):
            written(spark.range(5))
        assert inner.count() == 4
        path = inner.inputFiles()[0].removeprefix("file://")
    assert outer.count() == 3 and not os.path.exists(path)
