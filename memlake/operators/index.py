"""A kept full-text index: postings of the analyzed corpus that follow inserts, upserts and deletes.

``postings(token, id, dl, at)`` has one row per token and document with the token's places; ``sizes(id, dl)`` one row
per document. A change touches the rows of the changed documents only. Defined results: null ids and null texts are
not indexed, an empty text is a document of no tokens; a repeated id counts once, as first given; searching an index
gives what searching the texts gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.porter import stemmed_tokens
from memlake.operators import retrieval as R
from memlake.runtime import shuffle_partitions


@dataclass(frozen=True)
class Index:
    """Postings and document sizes with the analyzer that made them."""

    postings: DataFrame
    sizes: DataFrame
    analyze: object = stemmed_tokens


def build(docs: DataFrame, analyze=stemmed_tokens) -> Index:
    """The index of ``docs(id, text)``."""
    rows = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text").groupBy("id").agg(F.first("text").alias("text"))
    rows = rows.select("id", analyze("text").alias("tokens")).withColumn("dl", F.size("tokens"))
    places = rows.select("id", "dl", F.posexplode("tokens").alias("pos", "token"))
    return Index(places.groupBy("token", "id").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("at")), rows.select("id", "dl"), analyze)


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the documents of ``ids(id)``; unknown ones change nothing."""
    gone = ids.select("id").where("id IS NOT NULL").distinct()
    return Index(index.postings.join(gone, "id", "left_anti").select("token", "id", "dl", "at"), index.sizes.join(gone, "id", "left_anti"), index.analyze)


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the documents whose id it does not have yet."""
    new = build(docs.join(index.sizes.select("id"), "id", "left_anti"), index.analyze)
    return Index(index.postings.unionByName(new.postings), index.sizes.unionByName(new.sizes), index.analyze)


def upsert(index: Index, docs: DataFrame) -> Index:
    """The index with the documents added or replaced."""
    return insert(delete(index, docs), docs)


def save(index: Index, path: str) -> None:
    """Writes the index below ``path``; postings are range-sorted, so a search reads the files of its tokens only.

    ``path`` must not be the one the index was opened from: a snapshot is never overwritten while it is read.
    """
    n = shuffle_partitions(index.postings.sparkSession)
    index.postings.repartitionByRange(n, "token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def open_index(spark: SparkSession, path: str, analyze=stemmed_tokens) -> Index:
    """The index written below ``path``."""
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"), analyze)


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank) of all matches, with statistics over all documents of the index."""
    asked, parts = R.asked_words(queries, index.analyze, [])
    stats = index.sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = parts.select("token").distinct()
    hits = index.postings.join(F.broadcast(wanted) if R.is_small(wanted) else wanted, "token", "left_semi")
    return R.match_scores(hits.select("id", "dl", "token", F.explode("at").alias("pos")), stats, asked, parts, [])


def search(index: Index, queries: DataFrame, limit: int = 10, where: Column | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank, position) of the best hits; ``where`` filters by columns of ``docs``."""
    hits = scores(index, queries)
    if where is not None and docs is not None:
        hits = hits.join(docs.where(where).select("id"), "id", "left_semi")
    return R.best(hits, limit)
