"""Overlapping and gapped time intervals.

Rows are range-sorted over the whole table by (entity, start), so an entity with a third of all rows is
spread over many partitions. Every partition writes one summary of its last entity (first and last key, the
start of the last island and the largest end). The summaries, one row per partition, are combined from left
to right, and a second pass over the sorted partitions labels the rows with the state carried in.

Defined results
* a null start, or a start that is not before the end, leaves the row out;
* a null end means "without end";
* intervals are half open, so ``[a, b)`` and ``[b, c)`` touch and form one period;
* null keys form an entity of their own; repeated rows and ties change nothing;
* an empty table gives an empty result; columns other than the keys, start and end are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.runtime import checkpointed, shuffle_partitions

OPEN = 2**31 - 1  # the end of an interval without end, in days


def usable_date(c: Column | str) -> Column:
    """The day of ``YYYY-MM-DD``, RFC 3339 in UTC or ``YYYYMMDD``; null for anything else."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
    stamp = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|\+00:00)$"), F.substring(s, 1, 10))
    compact = F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
    return F.coalesce(iso, stamp, compact).try_cast("date")


def _differs(column: pa.Array, n: int) -> np.ndarray:
    """Where a value is not the same as the one before it, nulls being equal to each other."""
    a, b = column.slice(1, n - 1), column.slice(0, n - 1)
    ne = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _key(batch: pa.RecordBatch, row: int, n_keys: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in range(n_keys))


class _State:
    """The entity at hand, the start of its open island and the largest end so far."""

    def __init__(self, key=None, island=0, end=0):
        self.key, self.island, self.end = key, island, end


def _sweep(batch: pa.RecordBatch, n_keys: int, state: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: largest end before it within its entity, whether there is one, and the start of its island."""
    n = batch.num_rows
    start = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
    end = batch.column(n_keys + 1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.zeros(n, bool)
    for i in range(n_keys):
        new[1:] |= _differs(batch.column(i), n)
    carried = state.key is not None and state.key == _key(batch, 0, n_keys)
    new[0] = not carried
    group = np.cumsum(new)
    big = np.int64(1) << 33
    low = np.int64(1) << 32  # keeps days before 1970 positive
    lifted = group * big + end + low
    if carried:
        lifted[0] = max(lifted[0], group[0] * big + state.end + low)
    top = np.maximum.accumulate(lifted) - group * big - low
    before = np.empty(n, np.int64)
    before[1:] = top[:-1]
    before[0] = state.end if carried else 0
    has = ~new
    opens = new | (start > before)
    island = np.where(opens, np.arange(n), -1)
    island = np.maximum.accumulate(island)
    label = np.where(island >= 0, start[np.maximum(island, 0)], state.island)
    state.key, state.island, state.end = _key(batch, n - 1, n_keys), int(label[-1]), int(top[-1])
    return before, has, label


def _summaries(n_keys: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state = None, _State()
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1)
                _sweep(b, n_keys, state)
        if first is not None:
            row = [pa.array([TaskContext.get().partitionId()], pa.int32())]
            row += [first.column(i).cast(schema.field(f"first_{i}").type) for i in range(n_keys)]
            row += [pa.array([v], schema.field(f"last_{i}").type) for i, v in enumerate(state.key)]
            row += [pa.array([state.island], pa.int64()), pa.array([state.end], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, schema=schema)

    return run


def _rescan(n_keys: int, carry: dict[int, tuple], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _State(*carry.get(TaskContext.get().partitionId(), ()))
        for b in batches:
            if not b.num_rows:
                continue
            before, has, label = _sweep(b, n_keys, state)
            cols = [b.column(i).cast(schema.field(i).type) for i in range(n_keys + 2)]
            cols += [pa.array(before, pa.int64(), mask=~has), pa.array(label, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _swept(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, s, e, before, island): days; one row per entity and start, with the state of the sweep."""
    spark = df.sparkSession
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_date(F.col(start)).cast("long").alias("s"), F.coalesce(F.unix_date(F.col(end)), F.lit(OPEN)).cast("long").alias("e"))
    names = [f"k{i}" for i in range(len(keys))]
    rows = rows.where(F.col("s").isNotNull() & (F.col("s") < F.col("e"))).groupBy(*names, "s").agg(F.max("e").alias("e"))
    n = shuffle_partitions(spark)
    rows = checkpointed(rows.repartitionByRange(n, *names, "s").sortWithinPartitions(*names, "s"))

    kinds = [rows.schema[k].dataType for k in names]
    summary = T.StructType([T.StructField("pid", T.IntegerType())] + [T.StructField(f"{w}_{i}", t) for w in ("first", "last") for i, t in enumerate(kinds)] + [T.StructField("island", T.LongType()), T.StructField("end", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = rows.mapInArrow(_summaries(len(keys), to_arrow_schema(summary)), summary).collect()  # one row per partition
    carry, at = {}, None
    for r in sorted(parts, key=lambda r: r.pid):
        if at:
            carry[r.pid] = at
        first, last = (tuple(r[f"{w}_{i}"] for i in range(len(keys))) for w in ("first", "last"))
        island, top = r.island, r.end
        if at and first == last == at[0]:
            island, top = (at[1] if at[2] >= r.island else r.island), max(at[2], r.end)
        at = (last, island, top)
    out = T.StructType([rows.schema[k] for k in names] + [T.StructField(c, T.LongType()) for c in ("s", "e", "before", "island")])
    return rows.mapInArrow(_rescan(len(keys), carry, to_arrow_schema(out)), out)


def interval_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, gap_from, gap_to): the uncovered time between two periods of one entity, as dates."""
    swept = _swept(df, keys, start, end).where(F.col("before") < F.col("s"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return swept.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], day("before").alias("gap_from"), day("s").alias("gap_to"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, period_from, period_to, n_starts): the continuous periods; ``period_to`` is null without end."""
    names = [f"k{i}" for i in range(len(keys))]
    swept = _swept(df, keys, start, end).groupBy(*names, "island").agg(F.max("e").alias("e"), F.count("*").alias("n_starts"))
    day = lambda c: F.date_from_unix_date(c.cast("int"))
    return swept.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], day(F.col("island")).alias("period_from"), F.when(F.col("e") < OPEN, day(F.col("e"))).alias("period_to"), "n_starts")
