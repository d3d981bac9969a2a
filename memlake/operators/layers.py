"""The layers of recall: identity, essential story, filtered recall, full search."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import retrieval as R
from memlake.operators import store as S

EMPTY = "Palace is empty. Start by mining some data."


def identity(folder: str) -> str:
    """Layer 0: the identity file, trimmed; empty if there is none."""
    try:
        with open(os.path.join(folder, "identity.txt"), encoding="utf-8") as f:
            return f.read().strip()
    except OSError:
        return ""


def story(drawers: DataFrame) -> DataFrame:
    """Layer 1: one row with the essential story; wings in order of their names."""
    per = drawers.groupBy("wing").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("wings"), F.expr("listagg(concat(wing, ' (', n, ')'), ', ') WITHIN GROUP (ORDER BY wing)").alias("list"))
    rooms = drawers.agg(F.countDistinct("room").alias("rooms"))
    line: Column = F.concat(F.lit("Palace has "), F.col("total").cast("string"), F.lit(" memories across "), F.col("wings").cast("string"), F.lit(" wings and "), F.col("rooms").cast("string"), F.lit(" rooms.\nWings: "), F.col("list"))
    return per.crossJoin(rooms).select(F.coalesce(line, F.lit(EMPTY)).alias("story"))


def wake_up(drawers: DataFrame, folder: str) -> DataFrame:
    """Layers 0 and 1 as one text."""
    return story(drawers).select(F.concat(F.lit(identity(folder) + "\n\n"), "story").alias("text"))


def recall(drawers: DataFrame, wing: str = "", room: str = "", limit: int = 20) -> DataFrame:
    """Layer 2: drawers of a wing and room."""
    return S.get(drawers, S.Query(wing=wing, room=room, limit=limit if limit > 0 else 20))


def search(drawers: DataFrame, query: str, limit: int = 10, wing: str = "", room: str = "") -> DataFrame:
    """Layer 3: BM25 over everything; filters apply after scoring."""
    spark = drawers.sparkSession
    docs = drawers.select("id", F.col("document").alias("text"), "wing", "room", "source")
    asked = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
    hits = R.bm25(docs, asked, limit, S.Query(wing=wing, room=room).condition())
    return hits.join(docs, "id").select("position", "id", F.col("text").alias("document"), "wing", "room", "source", "rank", X.shown("text").alias("shown")).orderBy("position")
