"""Project trees and conversation folders to drawers.

Paths are filtered before any content is read. Defined results: unreadable, empty and blank files give no
drawer; equal chunks of a wing and room are one drawer, that of the first path.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import text as X
from memlake.operators.store import DRAWER, first_writer
from memlake.runtime import written
from memlake.sources.exports import transcripts


@dataclass(frozen=True)
class ProjectConfig:
    """Wing and room names of a project."""

    wing: str
    rooms: tuple[str, ...] = ()


@dataclass
class AppConfig:
    """Settings: defaults, then the file, then the environment."""

    store_path: str
    collection_name: str = "memlake_drawers"
    people_map: dict = field(default_factory=dict)
    topic_wings: dict = field(default_factory=dict)

    @staticmethod
    def load(folder: str) -> AppConfig:
        cfg = AppConfig(os.path.join(folder, "store"))
        try:
            with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
                known = json.load(f)
            for k in ("store_path", "collection_name", "people_map", "topic_wings"):
                if k in known:
                    setattr(cfg, k, known[k])
        except (OSError, ValueError):
            pass
        cfg.store_path = os.environ.get("MEMLAKE_STORE_PATH") or cfg.store_path
        return cfg

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "config.json"), "w", encoding="utf-8") as f:
            json.dump(self.__dict__, f, indent=2)


def read_project_config(path: str) -> ProjectConfig:
    """The project file; a missing or broken one is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, dict):
        raise ValueError("the project file holds no mapping")
    return ProjectConfig(raw.get("wing") or "", tuple(r["name"] for r in raw.get("rooms") or []))


def _read(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) below ``root``, paths relative to it; the content column is only read where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = os.path.abspath(root).rstrip("/") + "/"
    return files.select(F.substring(full, len(base) + 1, 1 << 20).alias("path"), F.decode("content", "UTF-8").alias("content"))


def project_files(files: DataFrame, skip: str = "", config_name: str = "memlake.yaml") -> DataFrame:
    """``files(path, content)`` without those that are hidden, built, binary, the project file or below ``skip``."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    name = F.element_at(parts, -1)
    ok = ~F.exists(folders, lambda p: p.isin(*L.SKIPPED_DIRS) | p.startswith(".")) & ~name.startswith(".") & ~ext.isin(*L.BINARY_EXTENSIONS) & (name != config_name)
    if skip:
        ok = ok & ~F.col("path").startswith(skip.rstrip("/") + "/")
    return files.where(ok).select("path", "content")


def walk_project(spark: SparkSession, root: str, skip: str = "", config_name: str = "memlake.yaml") -> DataFrame:
    """(path, content) of the text files of a project tree: no hidden, build or binary files."""
    return project_files(_read(spark, root), skip, config_name)


def walk_conversations(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the chat exports of a folder."""
    return _read(spark, root).where(F.lower("path").rlike(r"\.(txt|json|jsonl)$")).select("path", "content")


def _drawers(chunks: DataFrame) -> DataFrame:
    rows = chunks.withColumn("id", X.drawer_id("wing", "room", "document"))
    first = rows.groupBy("id").agg(F.min(F.struct("source", "n", *[c for c in DRAWER if c not in ("id", "source")])).alias("first"))
    return first.select("id", *[F.col(f"first.{c}").alias(c) for c in DRAWER if c != "id"])


def project_drawers(files: DataFrame, config: ProjectConfig, day: str) -> DataFrame:
    """Drawers of project files: paragraphs in chunks, rooms by path."""
    t = transcripts(files).where(X.trim_space("transcript") != "")
    rows = t.select(F.posexplode(X.chunks("transcript")).alias("n", "document"), F.lit(config.wing).alias("wing"), X.path_room("path", list(config.rooms)).alias("room"), F.col("path").alias("source"), F.lit(day).alias("filed_at"), F.lit("").alias("hall"))
    return _drawers(rows)


def conversation_drawers(files: DataFrame, wing: str, day: str, per_chunk: int = 1) -> DataFrame:
    """Drawers of chat exports: exchanges in groups, rooms by words."""
    t = transcripts(files).where(X.trim_space("transcript") != "")
    rows = t.select(F.posexplode(X.grouped(X.exchanges("transcript"), per_chunk)).alias("n", "document"), F.col("path").alias("source"))
    rows = rows.select("n", "document", F.lit(wing).alias("wing"), X.conversation_room("document").alias("room"), "source", F.lit(day).alias("filed_at"), F.lit("").alias("hall"))
    return _drawers(rows)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_STORE = "seq long, " + ", ".join(f"{c} string" for c in DRAWER)
_VECTORS = "id string, vector array<float>"


def write_store(drawers: DataFrame, path: str) -> None:
    """Appends a batch to the drawer table, partitioned by wing."""
    drawers.write.mode("append").partitionBy("wing").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored drawers as a snapshot; a store that is not there yet is empty. Of repeated ids the first stays."""
    return first_writer(spark.read.schema(_STORE).parquet(path)) if _exists(spark, path) else spark.createDataFrame([], _STORE)


def add_with_vectors(drawers: DataFrame, vectors: DataFrame, store: str, path: str) -> None:
    """Appends the drawers that the store lacks, and the vectors (id, vector) of just those, to their tables."""
    spark = drawers.sparkSession
    fresh = written(first_writer(drawers).join(open_store(spark, store).select("id"), "id", "left_anti"))
    write_store(fresh, store)
    vectors.join(fresh.select("id"), "id", "left_semi").select("id", F.col("vector").cast("array<float>").alias("vector")).write.mode("append").parquet(path)


def mine_with_vectors(drawers: DataFrame, embed, store: str, path: str) -> None:
    """From mined drawers (without ``seq``) to stored drawers and vectors; ``embed`` maps a text column to vectors."""
    top = open_store(drawers.sparkSession, store).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = written(drawers.withColumn("seq", F.monotonically_increasing_id() + F.lit(top + 1)))
    add_with_vectors(rows, rows.select("id", embed(F.col("document")).alias("vector")), store, path)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of a vector table; empty if it is not there."""
    return spark.read.schema(_VECTORS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], _VECTORS)


_ENTITIES = "id long, name string"
_TRIPLES = "id long, subject_id long, predicate string, object string, valid_from string, valid_to string"


def save_facts(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """Writes a snapshot of the fact store below ``path`` and then points to it, so readers see one state or the other."""
    spark = entities.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    entities.select("id", "name").write.parquet(f"{path}/{name}/entities")
    triples.write.parquet(f"{path}/{name}/triples")
    spark.createDataFrame([(name, int(time.time() * 1e6))], "name string, at long").coalesce(1).write.mode("append").json(f"{path}/current")


def open_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of the latest snapshot; both empty if there is none."""
    if not _exists(spark, f"{path}/current"):
        return spark.createDataFrame([], _ENTITIES), spark.createDataFrame([], _TRIPLES)
    name = spark.read.schema("name string, at long").json(f"{path}/current").orderBy(F.desc("at")).first().name
    return spark.read.parquet(f"{path}/{name}/entities"), spark.read.parquet(f"{path}/{name}/triples")


def write_results(results: DataFrame, path: str, latency_ms: float = 0.0) -> None:
    """Per-question results of an evaluation as CSV; the latency is that of the batch divided by its questions."""
    rows = results if "latency_ms" in results.columns else results.withColumn("latency_ms", F.lit(round(latency_ms)))
    kind = F.col("question_type") if "question_type" in results.columns else F.lit("")
    rows = rows.select(F.col("query_id").alias("question_id"), kind.alias("question_type"), F.col("found_at_5").cast("boolean").alias("found_at_5"), F.col("found_at_10").cast("boolean").alias("found_at_10"), "rank", "latency_ms")
    rows.write.mode("overwrite").option("header", True).csv(path)


_ENTRY = ["name", "type", "aliases", "source", "code"]
_REGISTRY = "ord long, name string, type string, aliases array<string>, source string, code string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entity registry from its JSON file, one object with the list ``entities``; ``ord`` is the place in the list.

    A missing file is an empty registry.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], _REGISTRY)
    entry = "struct<name:string, type:string, aliases:array<string>, source:string, code:string>"
    rows = spark.read.schema(f"entities array<{entry}>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("entities").alias("ord", "e")).select(F.col("ord").cast("long"), *[F.col(f"e.{c}").alias(c) for c in _ENTRY])


def write_registry(registry: DataFrame, path: str) -> None:
    """Writes the registry as one indented JSON object with the list ``entities`` in order of ``ord``, in a folder of one file.

    The file is one object by its format, so it is made in one task; a registry lists the entities that people keep.
    """
    entry = F.struct("ord", *[F.coalesce(c, F.array().cast("array<string>") if c == "aliases" else F.lit("")).alias(c) for c in _ENTRY])
    rows = registry.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    items = F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in _ENTRY]))
    rows.select(F.to_json(F.struct(items.alias("entities")), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, question_type, answer, session, date, gold, turn, role, content) of a retrieval benchmark file, one row per message."""
    message = "struct<role:string, content:string>"
    schema = f"question_id string, question_type string, question string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{message}>>, haystack_dates array<string>"
    q = spark.read.schema(schema).option("multiLine", True).json(path)
    s = q.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "question_type", "answer", "answer_session_ids", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("s", "messages"))
    s = s.withColumns({"session": F.coalesce(F.get("haystack_session_ids", F.col("s")), F.concat(F.lit("sess_"), F.col("s").cast("string"))), "date": F.get("haystack_dates", F.col("s"))})
    m = s.select("query_id", "query", "question_type", "answer", "session", "date", F.array_contains("answer_session_ids", F.col("session")).alias("gold"), F.posexplode("messages").alias("turn", "m"))
    return m.select("query_id", "query", "question_type", "answer", "session", "date", "gold", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
