"""Memory of the workers: what a task has used goes back to the system when it ends.

Spark keeps its Python workers from task to task, and an allocator keeps what was freed in them, so
that without this each operator would inherit the peak of the ones before it.  The executors' heaps
likewise stay as large as the largest sort has made them, until a full collection.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _M_ARENA_MAX = -1, -3, -8  # fixed values of malloc.h


def _glibc() -> ctypes.CDLL | None:
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def settle() -> None:
    """Arrow on the system's allocator; large blocks mapped on their own, and few free ones kept."""
    pa.set_memory_pool(pa.system_memory_pool())
    if (libc := _glibc()) is not None:
        libc.mallopt(_M_ARENA_MAX, 1)
        libc.mallopt(_M_MMAP_THRESHOLD, 8 << 20)
        libc.mallopt(_M_TRIM_THRESHOLD, 16 << 20)


def release() -> None:
    """Give back what is free."""
    if (libc := _glibc()) is not None:
        libc.malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Have each executor's JVM collect once and give back the heap that it no longer needs, before a stage
    of another kind begins; a request that a JVM may be set to ignore."""
    slots = max(1, spark.sparkContext.defaultParallelism)
    collect = F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, slots, 1, slots).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that settles its worker's memory before and releases it after."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        settle()
        try:
            yield from run(batches)
        finally:
            release()

    return task
