"""The stored tables that the registered queries start from, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.store import drawers
from memlake.runtime import read_table


def stored_drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawers(read_table(spark, sf_dir, "drawers"))


def document_drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as raw drawers: the id is the content id, the order that of doc_id."""
    d = read_table(spark, sf_dir, "documents")
    w, r, t = (F.coalesce(F.col(c), F.lit("")) for c in ("wing", "room", "text"))
    return d.select(
        F.col("doc_id").alias("seq"), F.md5(F.concat(w, r, t)).alias("id"), t.alias("document"), w.alias("wing"), r.alias("room"),
        F.coalesce("source", F.lit("")).alias("source"), F.lit("").alias("filed_at"), F.coalesce("kind", F.lit("")).alias("hall"),
    )


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


#: Stored drawers in SQL.
D = """d AS (SELECT seq, id, coalesce(document, '') AS document, coalesce(wing, '') AS wing, coalesce(room, '') AS room, coalesce(source, '') AS source,
  coalesce(filed_at, '') AS filed_at, coalesce(hall, '') AS hall FROM drawers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"""
DOC = """docd AS (SELECT doc_id AS seq, md5(coalesce(wing, '') || coalesce(room, '') || coalesce(text, '')) AS id, coalesce(text, '') AS document, coalesce(wing, '') AS wing,
  coalesce(room, '') AS room, coalesce(source, '') AS source, '' AS filed_at, coalesce(kind, '') AS hall FROM documents)"""
#: White space as trimmed by the library.
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def sql_trim(x: str) -> str:
    return f"trim({x}, {WS})"
