"""Sums of large arrays over all partitions, block by block and in levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64  # arrays of a block that one task adds up
SCHEMA = "block int, part int, x binary"


def block_rows(x: np.ndarray, size: int) -> pa.RecordBatch:
    """The blocks of ``size`` entries of a flat array that are not all zero, as rows of ``SCHEMA``."""
    full = np.zeros(-(-len(x) // size) * size, x.dtype)
    full[: len(x)] = x
    full = full.reshape(-1, size)
    used = np.flatnonzero(full.any(axis=1))
    task = TaskContext.get()
    part = np.full(len(used), task.partitionId() if task else 0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(part), pa.array([full[k].tobytes() for k in used], pa.binary())], names=["block", "part", "x"])


def sum_blocks(parts: DataFrame, dtype: str, size: int, length: int, tasks: int) -> np.ndarray:
    """The sum, on the driver, of the arrays that ``tasks`` tasks gave as ``block_rows``.

    A task streams through sorted rows and holds one block. While more than ``FAN``
    tasks contribute, the rows of a block are first added in groups of about ``FAN``.
    """

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in it:
            for block, part, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != at:
                    if at is not None:
                        yield _row(at, total.astype(dtype))
                    at, total = (block, part), np.zeros(size, "<f8" if "f" in dtype else "<i8")
                total += np.frombuffer(x, dtype)
        if at is not None:
            yield _row(at, total.astype(dtype))

    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int") if tasks > 1 else F.lit(0))
        parts = parts.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(add, SCHEMA)
        if tasks <= 1:
            break
    out = np.zeros(-(-length // size) * size, dtype)
    for r in parts.collect():  # ``length`` entries, fixed by the caller's parameters
        out[r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["x"], dtype)
    return out[:length]


def _row(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part", "x"])


def n_tasks(df: DataFrame) -> int:
    """Tasks of the last stage of ``df``, a scan or a chain of narrow steps over one."""
    return max(1, df._jdf.rdd().getNumPartitions())
