"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.canonical import canonicalize, look_alike_classes, look_alike_pairs
from memlake.llm.languages import document_languages, fit_word_scores, language_code, language_segments
from memlake.llm.leaks import find_leaks
from memlake.llm.names import link_names
from memlake.llm.neardup import similar_groups, similar_pairs
from memlake.llm.packing import CAPACITY, pack_documents
from memlake.llm.pii import find_mentions, redact
from memlake.runtime import read_table, written


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = look_alike_pairs(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return canonicalize(docs, "text").select("doc_id", F.col("canonical").alias("text"), F.col("canonical_segments").alias("n_segments"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alike class of every document: membership instead of pairs."""
    c = look_alike_classes(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "class_id", "n_equal", "n_forms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_items"), "question_id", "passage", "question")
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("question_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(read_table(spark, sf_dir, "drawers"), "id", "document", similarity=0.6, run=3)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_table(spark, sf_dir, "drawers"), "id", "document", similarity=0.6, run=3)


def name_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, spelling) of entities and registry: names and aliases under ``e`` + id and ``r`` + ord."""
    e = read_table(spark, sf_dir, "entities").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("rec"), F.col("name").alias("spelling"))
    r = read_table(spark, sf_dir, "registry").select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("rec"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("all"))
    return e.unionByName(r.select("rec", F.explode("all").alias("spelling")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = written(link_names(name_spellings(spark, sf_dir)))
    a, b = of.select("entity", F.col("rec").alias("key_a")), of.select("entity", F.col("rec").alias("key_b"))
    return a.join(b, "entity").where("key_a < key_b").select("key_a", "key_b")


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(name_spellings(spark, sf_dir))


def word_scores(spark: SparkSession, sf_dir: str) -> dict:
    return fit_word_scores(read_table(spark, sf_dir, "documents"), "text", "lang", "doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawers with several languages, or whose latest verdict is absent or names a language not in them."""
    labels = read_table(spark, sf_dir, "drawer_labels").where(F.col("drawer_id").isNotNull())
    latest = labels.groupBy(F.col("drawer_id").alias("id")).agg(F.max(F.struct("labeled_at", "lang_label")).alias("last")).select("id", language_code(F.col("last.lang_label")).alias("verdict"))
    found = document_languages(read_table(spark, sf_dir, "drawers"), "id", "document", word_scores(spark, sf_dir))
    langs = found.groupBy("id").agg(F.sort_array(F.collect_set("lang")).alias("langs")).join(latest, "id", "left")
    open_ = F.col("verdict").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("verdict"))
    return langs.where(open_).select(F.col("id").alias("drawer_id"), F.explode("langs").alias("lang"))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every drawer, with its confidence."""
    s = language_segments(read_table(spark, sf_dir, "drawers"), "id", "document", word_scores(spark, sf_dir))
    return s.select(F.col("id").alias("drawer_id"), F.col("first").alias("first_token"), F.col("end").alias("end_token"), "lang", "words", F.round("confidence", 4).alias("confidence")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_mentions(read_table(spark, sf_dir, "drawers"), "id", "document").withColumn("tab", F.lit("drawers"))
    m = find_mentions(read_table(spark, sf_dir, "messages"), "msg_id", "content").withColumn("tab", F.lit("messages"))
    return d.unionByName(m).select("tab", "rec_key", "kind", "pii")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redact(read_table(spark, sf_dir, "drawers"), "id", "document").withColumn("tab", F.lit("drawers"))
    m = redact(read_table(spark, sf_dir, "messages"), "msg_id", "content").withColumn("tab", F.lit("messages"))
    return d.unionByName(m).select("tab", "rec_key", "text", "n_mentions")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container."""
    return pack_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "wing", "room"])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of every container."""
    used = F.sum("n_tokens")
    return p6_packing(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n_items"), used.alias("used"), (F.lit(CAPACITY) - used).alias("unused"))


QUERIES = {"p6_packing": p6_packing, "p6_containers": p6_containers, "p5_found": p5_found, "p5_redacted": p5_redacted, "p2_found": p2_found, "p2_segments": p2_segments, "p1_found": p1_found, "p1_entities": p1_entities, "p3_found": p3_found, "p3_groups": p3_groups, "p7_found": p7_found, "p8_found": p8_found, "p8_canonical": p8_canonical, "p8_classes": p8_classes}
SQL: dict[str, str] = {
    "p3_found": """WITH t AS (SELECT DISTINCT id, list_filter(string_split_regex(lower(document), '\\s+'), lambda x: x <> '') AS w FROM drawers WHERE id IS NOT NULL AND document IS NOT NULL),
 s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) AS g FROM t WHERE len(w) >= 3), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
 SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)""",
}
