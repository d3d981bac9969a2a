"""Registered queries over the room graph and the fact store."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import graph as G
from memlake.plans.interval_queries import _ROWS, fact_intervals
from memlake.plans.store_queries import _EDGES
from memlake.plans.tables import D, stored_drawers
from memlake.runtime import read_table

START, HOPS, DAY, SUBJECT = "wing_core/design", 2, "2021-06-01", "Palace Steward"


def _kg(s, d):
    return read_table(s, d, "entities"), read_table(s, d, "triples")


def gr_build(s, d):
    return G.room_edges(stored_drawers(s, d))


def gr_traverse(s, d):
    return G.traverse(stored_drawers(s, d), START, HOPS).select("id", "wing", "room", "hop")


def gr_tunnels(s, d):
    return G.tunnels(stored_drawers(s, d), "wing_core", "wing_ops")


def gr_stats(s, d):
    return G.palace_stats(stored_drawers(s, d)).crossJoin(G.fact_stats(*_kg(s, d)))


def kg_query(s, d):
    return G.active_facts(*_kg(s, d), SUBJECT).select("id", "predicate", "object", "valid_from")


def flt_active(s, d):
    return G.active_facts(*_kg(s, d)).groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("object").alias("n_objects"))


def kg_at(s, d):
    return G.facts_at(*_kg(s, d), DAY).select("id", "subject", "predicate", "object")


def kg_timeline(s, d):
    return G.timeline(*_kg(s, d), SUBJECT).select("id", "predicate", "object", "valid_from", "valid_to")


def kg_stats(s, d):
    return G.fact_stats(*_kg(s, d))


def kg_at_batch(s, d):
    """Facts that hold on the first day of every month in which something was recorded of the subject."""
    probes = read_table(s, d, "triples").where("subject_id IS NOT NULL AND recorded_at IS NOT NULL").select("subject_id", F.trunc("recorded_at", "month").alias("day")).distinct()
    facts = fact_intervals(s, d).where("d_from IS NOT NULL AND (d_to IS NULL OR d_from < d_to)")
    return G.active_counts(facts, probes).select("subject_id", F.col("day").cast("string").alias("day"), "n_active")


QUERIES = {f.__name__: f for f in (gr_build, gr_traverse, gr_tunnels, gr_stats, kg_query, flt_active, kg_at, kg_at_batch, kg_timeline, kg_stats)}
_T = "t AS (SELECT t.id, e.name AS subject, predicate, object, valid_from, coalesce(valid_to, '') AS valid_to FROM triples t JOIN entities e ON e.id = t.subject_id)"
SQL = {
    "gr_build": f"WITH {D}, {_EDGES} SELECT src, dst FROM edges",
    "gr_traverse": f"""WITH RECURSIVE {D}, {_EDGES}, walk AS (SELECT '{START}' AS node, 0 AS hop UNION SELECT e.dst, hop + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE hop < {HOPS}),
 seen AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node) SELECT id, wing, room, hop FROM d JOIN seen ON seen.node = wing || '/' || room""",
    "gr_tunnels": f"WITH {D} SELECT room FROM d WHERE wing = 'wing_core' INTERSECT SELECT room FROM d WHERE wing = 'wing_ops'",
    "gr_stats": f"WITH {D}, {_EDGES} SELECT count(DISTINCT wing) AS wings, count(DISTINCT wing || '/' || room) AS rooms, count(*) AS drawers, (SELECT count(*) // 2 FROM edges) AS connections, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM triples) AS triples FROM d",
    "kg_query": f"WITH {_T} SELECT id, predicate, object, valid_from FROM t WHERE subject = '{SUBJECT}' AND valid_to = ''",
    "flt_active": f"WITH {_T} SELECT subject, count(*) AS n, count(DISTINCT object) AS n_objects FROM t WHERE valid_to = '' GROUP BY subject",
    "kg_at": f"WITH {_T} SELECT id, subject, predicate, object FROM t WHERE valid_from <= '{DAY}' AND (valid_to = '' OR valid_to > '{DAY}')",
    "kg_at_batch": _ROWS + """, f AS (SELECT subject_id, s, CASE WHEN open THEN NULL ELSE e0 END AS e FROM raw WHERE s IS NOT NULL AND (open OR e0 IS NOT NULL) AND s < coalesce(CASE WHEN open THEN NULL ELSE e0 END, DATE '9999-12-31')),
 p AS (SELECT DISTINCT subject_id, CAST(date_trunc('month', recorded_at AT TIME ZONE 'UTC') AS DATE) AS day FROM triples WHERE subject_id IS NOT NULL AND recorded_at IS NOT NULL)
 SELECT p.subject_id, CAST(day AS VARCHAR) AS day, count(s) AS n_active FROM p LEFT JOIN f ON f.subject_id = p.subject_id AND s <= day AND (e IS NULL OR day < e) GROUP BY ALL""",
    "kg_timeline": f"WITH {_T} SELECT id, predicate, object, valid_from, valid_to FROM t WHERE subject = '{SUBJECT}'",
    "kg_stats": "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM triples) AS triples",
}
