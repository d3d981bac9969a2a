"""Registered queries over the temporal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.intervals import interval_gaps, merge_intervals, usable_date
from memlake.runtime import read_table

FACT = ["subject_id", "predicate", "object"]


def fact_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with a subject and usable dates; an end that cannot be read makes a row unusable."""
    t = read_table(spark, sf_dir, "triples").where(F.col("subject_id").isNotNull())
    blank = F.col("valid_to").isNull() | (F.trim("valid_to") == "")
    t = t.select(*FACT, usable_date("valid_from").alias("d_from"), usable_date("valid_to").alias("d_to"), blank.alias("open"))
    return t.where(F.col("open") | F.col("d_to").isNotNull()).drop("open")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = interval_gaps(fact_intervals(spark, sf_dir), FACT, "d_from", "d_to")
    return g.select(*FACT, F.col("gap_from").cast("string").alias("gap_from"), F.col("gap_to").cast("string").alias("gap_to"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = merge_intervals(fact_intervals(spark, sf_dir), FACT, "d_from", "d_to")
    return p.select(*FACT, F.col("period_from").cast("string").alias("period_from"), F.col("period_to").cast("string").alias("period_to"), "n_starts")


_DAY = """CASE WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(trim({c}) AS DATE)
  WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|\\+00:00)') THEN TRY_CAST(substr(trim({c}), 1, 10) AS DATE)
  WHEN regexp_full_match(trim({c}), '\\d{{8}}') THEN TRY_CAST(substr(trim({c}), 1, 4) || '-' || substr(trim({c}), 5, 2) || '-' || substr(trim({c}), 7, 2) AS DATE) END"""

_ROWS = f"""WITH raw AS (
  SELECT subject_id, predicate, object, {_DAY.format(c='valid_from')} AS s, {_DAY.format(c='valid_to')} AS e0, (valid_to IS NULL OR trim(valid_to) = '') AS open
  FROM triples WHERE subject_id IS NOT NULL),
rows AS (
  SELECT subject_id, predicate, object, s, max(coalesce(e0, DATE '9999-12-31')) AS e
  FROM raw WHERE s IS NOT NULL AND (open OR e0 IS NOT NULL) AND s < coalesce(e0, DATE '9999-12-31') GROUP BY ALL),
swept AS (
  SELECT *, max(e) OVER (PARTITION BY subject_id, predicate, object ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows)"""

SQL = {
    "p4_found": _ROWS + " SELECT subject_id, predicate, object, CAST(before AS VARCHAR) AS gap_from, CAST(s AS VARCHAR) AS gap_to FROM swept WHERE before < s",
    "p4_periods": _ROWS
    + """, marked AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate, object ORDER BY s) AS island FROM swept)
 SELECT subject_id, predicate, object, CAST(min(s) AS VARCHAR) AS period_from, CASE WHEN max(e) < DATE '9999-12-31' THEN CAST(max(e) AS VARCHAR) END AS period_to, count(*) AS n_starts
 FROM marked GROUP BY subject_id, predicate, object, island""",
}
QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
