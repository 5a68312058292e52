"""Running sums over ordered keys of any size, and sums over a window of positions.

A window function gives a whole key to one task. Here rows are dealt by ranges of (keys, order), so a large key lies in many partitions; each
adds up its own rows in order, and starts from what the partitions before it hold of its first key. Only that first key can have begun
earlier, so the offsets are a row a partition, which every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from driftwood.operators.tables import written


def _breaks(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before it; the first row counts as different."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for k in keys:
        code = batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with sums {name: bigint column}: what the rows of its keys that come before a row in `order` (total) add up to.

    All tasks share a large key. rows are written once, sorted by range; null keys are a key, an empty table stays empty. Values must not be null.
    """
    names = list(sums)
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    schema = StructType([f for f in held.schema if f.name not in ("_part", "_row")])
    at = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("_part", *keys).agg(F.min("_row").alias("_row"), *[F.sum(c).alias(n) for n, c in sums.items()])
    since = blocks.select("_part", "_row", *[F.coalesce(F.sum(n).over(at), F.lit(0)).alias(n) for n in names])
    # of a partition's keys only the first has rows before it
    offsets = {r["_part"]: list(r["first"])[1:] for r in since.groupBy("_part").agg(F.min(F.struct("_row", *names)).alias("first")).collect()}
    parts = held.sparkSession.createDataFrame([(p, v) for p, v in offsets.items()], "_part int, _since array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, part = None, np.zeros(len(names), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index("_part")).to_numpy()
            for low, high in zip(*(lambda e: (e, [*e[1:], len(own)]))([0, *(np.flatnonzero(np.diff(own)) + 1).tolist()]), strict=True):
                some = batch.slice(low, high - low)
                new = _breaks(some, keys)
                value = np.stack([some.column(some.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in sums.values()], 1)
                before = np.cumsum(value, 0) - value
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                out = before - before[first]
                begin = _key(some, keys, 0)
                if part != own[low]:
                    part, last = own[low], begin
                    carry = np.array(some.column(some.schema.get_field_index("_since"))[0].as_py(), np.int64)
                if begin == last:
                    out[first == 0] += carry
                carry, last = out[-1] + value[-1], _key(some, keys, len(new) - 1)
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(f.name)) for f in schema), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(names)))], [*schema.names, *names])

    # a file of `held` may be read in several pieces and several files by one task, so a task takes one partition after another, each whole and in order
    whole = held.join(F.broadcast(parts), "_part").repartition("_part").sortWithinPartitions("_part", "_row")
    return whole.mapInArrow(run, StructType([*schema.fields, *[StructField(n, LongType()) for n in names]]))


def windowed(rows: DataFrame, keys: list[str], at: str, sums: dict[str, str], window: int, wide: bool = False) -> DataFrame:
    """(keys, at, sums): for each row what the rows of its keys from at - window to at - 1 add up to. rows are unique by (keys, at); sums: {name: bigint column}.

    Each row asks twice: at its place, and `window` before it; the answer is the difference of two running sums, whatever the window. wide: keys are shared
    by all tasks (running()), else a key is one task's window.
    """
    values = list(dict.fromkeys(sums.values()))
    placed = rows.select(*keys, F.col(at).alias("_own"), *values)
    events = placed.withColumns({"_at": F.col("_own"), "_kind": F.lit(1)})
    probes = placed.withColumns({**{c: F.lit(0).cast("bigint") for c in values}, "_at": F.col("_own") - window, "_kind": F.lit(0)})
    both = events.unionByName(probes)
    names = {f"_s{i}": c for i, c in enumerate(values)}
    if wide:
        told = running(both, keys, ["_at", "_kind"], names)
    else:
        so_far = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
        told = both.withColumns({n: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for n, c in names.items()})
    back = {c: n for n, c in names.items()}
    signed = [F.sum(F.when(F.col("_kind") == 1, F.col(back[c])).otherwise(-F.col(back[c]))).alias(n) for n, c in sums.items()]
    return told.groupBy(*keys, F.col("_own").alias(at)).agg(*signed)


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with pos: 1, 2, ... within keys by `order` (total), a large key shared by all tasks."""
    one = rows.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, keys, order, {"_before": "_one"}).withColumn("pos", F.col("_before") + 1).drop("_one", "_before")
