"""Run a vectorised function over the text of a DataFrame and append what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import CHUNK_BYTES, chunks
from .workers import released

BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def lower_batches(spark: SparkSession) -> dict[str, str]:
    """Arrow batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` from here on, for a session that the
    caller owns; what they were before.  Texts and sets are long, and the default of ten thousand rows holds tens of megabytes in
    every task, once on each side of the pipe."""
    before = {name: spark.conf.get(name) for name in _LIMITS}
    for name, most in _LIMITS.items():
        if not 0 < int(before[name].rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs inside; the session is then as it was."""
    before = lower_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The rows under column names of their own, the new names of ``names``, and a function that gives the rows left
    their names back: what an operator adds can then clash with none of them."""
    new = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    old = [F.col(f"`{c}`").alias(n) for c, n in new.items()]

    def restored(left: DataFrame) -> DataFrame:
        return left.select(*[F.col(n).alias(c) for c, n in new.items()])

    return docs.select(*old), [new[c] for c in names], restored


ChunkFunction = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def map_text(
    df: DataFrame,
    text: str,
    start: Callable[[], ChunkFunction],
    new: list[T.StructField],
    keep: list[str] | None = None,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Append ``new`` columns computed from column ``text`` chunk by chunk.

    ``start`` is called once in each task and returns the function of (bytes, row offsets) of about
    ``limit`` bytes.
    ``keep`` names the input columns to carry over (all by default); one that has the name of a
    new column is replaced by it.  A null text is read as the empty one.
    """
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in names]
    kept_names = [f.name for f in kept]
    hidden = "__text"
    while hidden in df.columns:
        hidden += "_"
    source = df.select(*[df[n] for n in kept_names], df[text].cast("string").alias(hidden))
    out_names = kept_names + [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        width = len(kept_names)
        for batch in batches:
            for at, data, offsets in chunks(batch.column(width), limit):
                rows = batch.slice(at, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(width)] + fn(data, offsets), names=out_names)

    return source.mapInArrow(released(run), T.StructType(kept + new))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a flat array as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def gather(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[offsets[p]:offsets[p+1]] for p in picks; also the end of each piece."""
    lengths = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(offsets[picks] - (ends - lengths), lengths) + np.arange(total)
    return flat[where], ends
