"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, so that long texts do not pile up in a task.
SLICE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most `rows` texts go to a Python worker at once, for this session's later plans.

    An Arrow batch is held by the executor and the worker, twice each while it grows. The setting changes no result; a
    smaller one that is already there stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def drop_unused(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are no longer referred to.

    It does so when the driver collects its garbage, which may otherwise be long after a large step.
    """
    gc.collect()
    spark._jvm.System.gc()


def gathered(batches, size: int) -> Iterator[pa.Table]:
    """Arrow batches put together until they hold `size` bytes or more."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(batches, rows: int = SLICE) -> Iterator:
    """Arrow batches cut into short ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def finite_vector(vector: Column) -> Column:
    """True for an array without null, NaN or infinite components."""
    ok = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    )
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if len(keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
