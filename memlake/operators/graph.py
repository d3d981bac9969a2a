"""Graphs over drawers, and the temporal fact store.

Rooms are linked when they share a source. Results are defined for nulls: a null or empty source links
nothing; a null ``valid_to`` is the empty one, that is, the fact still holds; unknown starts and subjects
give no rows; repeated rows change nothing but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.runtime import written


def _room() -> Column:
    """The name of a room node."""
    return F.concat_ws("/", "wing", "room")


def room_sources(drawers: DataFrame) -> DataFrame:
    """(node, source): the distinct rooms of every source."""
    return drawers.where(F.col("source").isNotNull() & (F.col("source") != "")).select(_room().alias("node"), "source").distinct()


def room_edges(drawers: DataFrame) -> DataFrame:
    """(src, dst): both directions of every link; the distinct rooms of a source are joined, not its drawers."""
    r = room_sources(drawers)
    a, b = r.select(F.col("node").alias("src"), "source"), r.select(F.col("node").alias("dst"), "source")
    return a.join(b, "source").where("src != dst").select("src", "dst").distinct()


def hops(drawers: DataFrame, start: str, most: int) -> DataFrame:
    """(node, hop): rooms within ``most`` links of ``start``; goes through sources, so no link table is built."""
    rs = written(room_sources(drawers))
    seen = drawers.select(_room().alias("node")).where(F.col("node") == start).distinct().withColumn("hop", F.lit(0))
    frontier = seen = written(seen)
    for k in range(1, most + 1):
        sources = frontier.join(rs, "node").select("source").distinct()
        near = rs.join(sources, "source", "left_semi").select("node").distinct()
        frontier = written(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(k)))
        seen = written(seen.unionByName(frontier))
    return seen


def traverse(drawers: DataFrame, start: str, most: int = 2) -> DataFrame:
    """Drawers of all rooms within ``most`` hops, with the hop."""
    return drawers.join(hops(drawers, start, most), _room() == F.col("node")).drop("node")


def tunnels(drawers: DataFrame, wing_a: str, wing_b: str) -> DataFrame:
    """(room): names of rooms that both wings have."""
    rooms = lambda w: drawers.where(F.col("wing") == w).select("room")
    return rooms(wing_a).intersect(rooms(wing_b))


def palace_stats(drawers: DataFrame) -> DataFrame:
    """One row: wings, rooms, drawers, connections."""
    counts = drawers.agg(F.countDistinct("wing").alias("wings"), F.countDistinct(_room()).alias("rooms"), F.count("*").alias("drawers"))
    return counts.crossJoin(room_edges(drawers).agg((F.count("*") / 2).cast("long").alias("connections")))


def _facts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    t = triples.withColumn("valid_to", F.coalesce("valid_to", F.lit("")))
    return t.join(entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")


def active_facts(entities: DataFrame, triples: DataFrame, subject: str | None = None) -> DataFrame:
    """Facts without an end, of one subject or of all."""
    out = _facts(entities if subject is None else entities.where(F.col("name") == subject), triples)
    return out.where("valid_to = ''")


def facts_at(entities: DataFrame, triples: DataFrame, day: str, subject: str | None = None) -> DataFrame:
    """Facts that hold on ``day``: from ``valid_from`` up to, not including, ``valid_to``; dates compare as text."""
    out = _facts(entities if subject is None else entities.where(F.col("name") == subject), triples)
    return out.where((F.col("valid_from") <= day) & ((F.col("valid_to") == "") | (F.col("valid_to") > day)))


def active_counts(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """(subject_id, day, n_active): how many ``facts(subject_id, d_from, d_to)`` hold on each probed day.

    The interval join of many probes as a sweep: starts count up, ends count down, and the running sum at a
    probe is its answer. Counts are combined per subject and day before the sweep, so a subject with a third
    of all facts is a window of at most one row per day.
    """
    up = facts.select("subject_id", F.col("d_from").alias("day"), F.lit(1).alias("delta"), F.lit(False).alias("probe"))
    down = facts.where("d_to IS NOT NULL").select("subject_id", F.col("d_to").alias("day"), F.lit(-1).alias("delta"), F.lit(False).alias("probe"))
    asked = probes.select("subject_id", "day", F.lit(0).alias("delta"), F.lit(True).alias("probe"))
    days = up.unionByName(down).unionByName(asked).where("subject_id IS NOT NULL AND day IS NOT NULL")
    days = days.groupBy("subject_id", "day").agg(F.sum("delta").alias("delta"), F.max("probe").alias("probe"))
    w = Window.partitionBy("subject_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("n_active", F.sum("delta").over(w)).where("probe").select("subject_id", "day", "n_active")


def timeline(entities: DataFrame, triples: DataFrame, subject: str) -> DataFrame:
    """All facts of a subject in order of ``valid_from``, then id."""
    return _facts(entities.where(F.col("name") == subject), triples).orderBy("valid_from", "id")


def fact_stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: entities, triples."""
    return entities.agg(F.count("*").alias("entities")).crossJoin(triples.agg(F.count("*").alias("triples")))
