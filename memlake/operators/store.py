"""The drawer store and the fact store as snapshots: reads, inserts, upserts, deletes.

A snapshot is a DataFrame; every change gives a new one. Defined results: a null id is never stored; of
repeated ids the row with the smallest ``seq`` wins (first writer); null text columns are stored as ``''``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWER = ["id", "document", "wing", "room", "source", "filed_at", "hall"]


@dataclass(frozen=True)
class Query:
    """Equality filters; an empty string filters nothing."""

    wing: str = ""
    room: str = ""
    hall: str = ""
    limit: int = 0
    offset: int = 0

    def condition(self) -> Column:
        out = F.lit(True)
        for k in ("wing", "room", "hall"):
            if getattr(self, k):
                out = out & (F.col(k) == getattr(self, k))
        return out


def first_writer(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per key: only keys and order numbers are shuffled to decide which."""
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return rows.join(kept, [key, order], "left_semi")


def drawers(rows: DataFrame) -> DataFrame:
    """The stored drawers of raw rows."""
    return first_writer(rows).select("seq", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c != "id" else F.col(c) for c in DRAWER])


def get(store: DataFrame, q: Query) -> DataFrame:
    """Drawers that match, with their ``seq``; in order of insertion if an offset or a limit cuts them.

    Without a cut the table is only filtered: a global sort of all rows would serve nobody who goes on with Spark.
    """
    out = store.where(q.condition())
    if not q.offset and not q.limit:
        return out
    out = out.orderBy("seq")
    if q.offset:
        out = out.offset(q.offset)
    return out.limit(q.limit) if q.limit else out


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new ids added; ids already stored are ignored."""
    fresh = first_writer(new).join(store.select("id"), "id", "left_anti")
    return store.unionByName(fresh.select(store.columns))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new ids added and the other columns of known ids replaced; they keep their ``seq``."""
    latest = new.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("seq").alias("seq"))
    rows = new.join(latest, ["id", "seq"], "left_semi")
    known = store.select("id", F.col("seq").alias("old_seq"))
    replaced = rows.join(known, "id", "left").withColumn("seq", F.coalesce("old_seq", "seq")).select(store.columns)
    return store.join(rows.select("id"), "id", "left_anti").unionByName(replaced)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the ids; unknown ones change nothing."""
    return store.join(ids.select("id").where("id is not null").distinct(), "id", "left_anti")


def add_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The entities with an id for every new name: the largest id plus the rank of the name."""
    fresh = names.select("name").where(F.col("name").isNotNull()).distinct().join(entities.select("name"), "name", "left_anti")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    n = max(1, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = fresh.repartitionByRange(n, "name").sortWithinPartitions("name").withColumn("pid", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() % F.lit(1 << 33))
    from memlake.runtime import checkpointed

    ranged = checkpointed(ranged)
    sizes = {r["pid"]: r["count"] for r in ranged.groupBy("pid").count().collect()}  # one row per partition
    base, total = [], 0
    for pid in range(n):
        base.append(total)
        total += sizes.get(pid, 0)
    numbered = ranged.crossJoin(F.broadcast(top)).select((F.col("top") + F.lit(1) + F.col("k") + F.element_at(F.array(*map(F.lit, base)), F.col("pid") + 1)).alias("id"), "name")
    return entities.select("id", "name").unionByName(numbered)


def invalidate(triples: DataFrame, facts: DataFrame, day: str) -> DataFrame:
    """Active rows of the given (subject_id, predicate, object) closed on ``day``."""
    keys = ["subject_id", "predicate", "object"]
    hit = facts.select(*keys).distinct().withColumn("hit", F.lit(True))
    out = triples.join(hit, keys, "left")
    active = F.coalesce(F.col("valid_to"), F.lit("")) == ""
    return out.withColumn("valid_to", F.when(active & F.col("hit"), F.lit(day)).otherwise(F.coalesce("valid_to", F.lit("")))).drop("hit")
