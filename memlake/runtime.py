"""Session helpers shared by all operators: tables, lineage cuts and partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in bytes of its files, that an operator may send to every executor.
BROADCAST_BYTES = 8 << 20
#: Paths of written tables, one list for each open ``scratch`` block around the outermost.
_TABLES: list[list[str]] = [[]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, over all cores; filters and column choices pass through to the scan."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    if not known:
        known = sc._jsc.sc().getCheckpointDir()
        known = known.get() if known.isDefined() else None
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        known = "file://" + tempfile.mkdtemp(prefix="memlake-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder with its partitions and their order kept."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a compressed columnar table and read from there."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    _TABLES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written within the block at its end, and no others: the results of the block must be used up by then."""
    _TABLES.append([])
    try:
        yield
    finally:
        _delete(spark, _TABLES.pop())


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables written outside of every ``scratch`` block; call it when no result that reads them is needed any more."""
    _delete(spark, _TABLES[0])


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` may go to every executor; compressed files are taken as an eighth of the rows in memory."""
    return table_bytes(df) * 8 <= BROADCAST_BYTES


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few for that; larger inputs stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; used to decide on broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
