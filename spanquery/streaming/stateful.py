"""Streams with state: interval joins, session and hopping windows, traces that end, and windows under a watermark
for each source partition with late rows put aside."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import Measures, finished, interval, measured, merged, micros_of, panes
from ..tables import drop
from .jobs import WATERMARK

NOW = {"availableNow": True}


def append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream's rows to a table, each once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": WATERMARK})).start()


def interval_join(left: DataFrame, right: DataFrame, on: dict[str, str], ts: str, right_ts: str, within: str, how: str = "left_outer", delay: str = WATERMARK) -> DataFrame:
    """Rows of two streams with equal keys (``on``: left to right), the right one at most ``within`` later.

    Both sides are kept until the watermark says that nothing can meet them, so the state is what arrives in ``within``
    and the delay.  An outer row comes out, once, when its time has passed.  No column name may be on both sides.
    """
    if both := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"columns on both sides: {', '.join(sorted(both))}")
    left, right = left.withWatermark(ts, delay), right.withWatermark(right_ts, delay)
    same = F.lit(True)
    for a, b in on.items():
        same = same & (F.col(a) == F.col(b))
    return left.join(right, same & (F.col(right_ts) >= F.col(ts)) & (F.col(right_ts) <= F.col(ts) + F.expr(f"interval {within}")), how)


def session_windows(rows: DataFrame, keys: Sequence[str], ts: str, gap: str, measures: Measures, delay: str = WATERMARK) -> DataFrame:
    """Stretches of a key's rows with no silence longer than ``gap``, each once it can grow no more; the batch form is
    ``temporal.sessions``."""
    out = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*measured(measures))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *finished(measures))


def hopping_windows(rows: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, measures: Measures, delay: str = WATERMARK) -> DataFrame:
    """``temporal.hopping`` on a stream: closed panes of one slide go on into windows, so that no row is copied."""
    made = rows.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("pane"), *keys).agg(*measured(measures))
    out = made.groupBy(F.window(F.window_time("pane"), size, slide).alias("w"), *keys).agg(*merged(measures))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *finished(measures))


TRACE = "trace_id string, reason string, spans long, errors long, first_ts timestamp, last_ts timestamp"
BUCKETS = 4096  # of traces, each with one state
_OPEN = ("spans", "errors", "first", "last", "due")
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # for rows without a time


def _gathered(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row a trace of rows that are traces so far or spans."""
    at, ids = pd.factorize(rows["trace_id"], use_na_sentinel=False)
    out = {"trace_id": np.asarray(ids, dtype=object)}
    for name, ufunc, start in (("spans", np.add, 0), ("errors", np.add, 0), ("first", np.minimum, _MOST), ("last", np.maximum, _LEAST), ("due", np.maximum, _LEAST), ("roots", np.add, 0), ("fresh", np.maximum, 0)):
        out[name] = np.full(len(ids), start, dtype=np.int64)
        ufunc.at(out[name], at, rows[name])
    return out


def closed_traces(spans: DataFrame, silence: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """A row for each trace that has ended: by its root, which is emitted last (``root``), or because nothing came for
    so long (``silence``).  What comes after the end opens the trace again, to be closed by silence.

    Traces are dealt to ``BUCKETS`` by their id and go to Python by bucket, so that no call is for one trace alone.  The state of a
    bucket is its open traces, five numbers each; it wakes up when the first of them is due.
    """
    quiet = micros_of(silence) // 1000

    def close(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        ids, *numbers = state.get if state.exists else [[]] * (1 + len(_OPEN))
        held = {"trace_id": np.array(ids, dtype=object)} | {n: np.array(v, dtype=np.int64) for n, v in zip(_OPEN, numbers, strict=True)}
        held["roots"] = held["fresh"] = np.zeros(len(ids), dtype=np.int64)
        for part in filter(len, parts):  # a timeout brings an empty one
            one, at = np.ones(len(part), dtype=np.int64), part["at"].isna().to_numpy()
            low, high = (part["at"].fillna(0).to_numpy(dtype=np.int64).copy() for _ in range(2))
            low[at], high[at] = _MOST, _LEAST
            new = {"trace_id": part["trace_id"].to_numpy(dtype=object), "spans": one, "errors": part["error"].to_numpy(dtype=np.int64), "first": low, "last": high, "due": 0 * one + _LEAST, "roots": part["root"].to_numpy(dtype=np.int64), "fresh": one}
            held = _gathered({n: np.concatenate([held[n], v]) for n, v in new.items()})
        held["due"] = np.where(held["fresh"] > 0, np.maximum(held["last"] // 1000 + quiet, now + 1), held["due"])
        ended = (held["roots"] > 0) | (held["due"] < now)
        left = {n: held[n][~ended].tolist() for n in ("trace_id", *_OPEN)}
        if left["due"]:
            state.update(tuple(left.values()))
            state.setTimeoutTimestamp(max(min(left["due"]), now + 1))
        elif state.exists:
            state.remove()
        if ended.any():
            done = {n: v[ended] for n, v in held.items()}
            times = {n: pd.array(done[n], dtype="Int64") for n in ("first", "last")}
            for v in times.values():
                v[done["last"] == _LEAST] = pd.NA
            yield pd.DataFrame({"trace_id": done["trace_id"], "reason": np.where(done["roots"] > 0, "root", "silence"), "spans": done["spans"], "errors": done["errors"], **times})

    kept = spans.withWatermark("ts", delay)
    kept = kept.select(
        F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "trace_id", F.col("parent_span_id").isNull().alias("root"),
        F.coalesce(F.col("status") == "error", F.lit(False)).alias("error"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ts",
    )
    open_ = "trace_id array<string>, " + ", ".join(f"{n} array<long>" for n in _OPEN)
    out = kept.groupBy("bucket").applyInPandasWithState(close, "trace_id string, reason string, spans long, errors long, first long, last long", open_, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("trace_id", "reason", "spans", "errors", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"))


def _at(time: dt.datetime, kind: T.DataType) -> Column:
    """A time that was read from a column of this type, in which it has no zone or the process's own."""
    return F.lit(str(time)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(time)


def _folder(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/batch={batch}"


def partitioned_windows(
    rows: DataFrame, path: str, checkpoint: str, partition: str, keys: Sequence[str], ts: str, width: str, measures: Measures,
    delay: str = WATERMARK, idle_after: int = 2, trigger: dict | None = None,
) -> StreamingQuery:
    """Tumbling windows under a watermark for each source partition; late rows go to a table of their own.

    The watermark is the least over the active partitions of their greatest time, less ``delay``; it never goes back.  A
    partition without rows in ``idle_after`` batches running is idle and holds nothing up until it has rows again.
    (Spark's own watermark is one maximum over all partitions: a partition that lags loses its rows.)

    Under ``path``: ``windows`` has the groups that have closed and, for the last batches, those still open (``closed``
    false); ``late`` the rows whose window had closed, or that have no time, as they came; ``partitions`` the
    greatest time of each partition.  Each batch writes folders named by its id from those of the batch before,
    so that a batch that is replayed after a failure writes the same again: windows and late rows hold every row once.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            seen = batch.groupBy(F.col(partition).cast("string").alias("partition")).agg(F.max(ts).alias("greatest"))
            now = {r.partition: r.greatest for r in seen.collect()}  # a row a source partition
            before = _partitions(spark, path, batch_id - 1)
            passed = next((r["watermark"] for r in before.values()), None)
            after = {}
            for p in {*before, *now}:
                old = before.get(p, {"greatest": None, "idle": 0})
                times = [t for t in (old["greatest"], now.get(p)) if t is not None]
                after[p] = {"greatest": max(times, default=None), "idle": 0 if p in now else old["idle"] + 1}
            active = [r["greatest"] for r in after.values() if r["idle"] < idle_after]
            reached = min(active) - dt.timedelta(microseconds=micros_of(delay)) if active and None not in active else None
            mark = max([m for m in (passed, reached) if m is not None], default=None)

            kind = batch.schema[ts].dataType
            stamp, none = kind.simpleString(), F.lit(None).cast(kind)
            sound = batch.where(F.col(ts).isNotNull()).withColumn("__end", F.window(ts, width)["end"])
            behind = F.lit(False) if passed is None else F.col("__end") <= _at(passed, kind)
            good = sound.where(~behind).drop("__end")
            late = sound.where(behind).drop("__end").unionByName(batch.where(F.col(ts).isNull()))
            late.withColumn("watermark", none if passed is None else _at(passed, kind)).write.mode("overwrite").parquet(_folder(path, "late", batch_id))

            made = panes(good, keys, ts, width, measures)
            if batch_id:
                open_ = spark.read.schema(made.schema).parquet(f"{_folder(path, 'windows', batch_id - 1)}/closed=false")
                made = made.unionByName(open_).groupBy("pane", *keys).agg(*[m.cast(made.schema[n].dataType).alias(n) for n, m in zip(measures, merged(measures), strict=True)])
            ended = F.lit(False) if mark is None else F.col("pane") + interval(width) <= _at(mark, kind)
            target = _folder(path, "windows", batch_id)
            made.withColumn("closed", ended).write.mode("overwrite").partitionBy("closed").parquet(target)
            made.where("false").write.mode("append").parquet(f"{target}/closed=false")  # so that there is one
            kept = [(p, r["greatest"], r["idle"], mark) for p, r in after.items()]
            spark.createDataFrame(kept, f"partition string, greatest {stamp}, idle int, watermark {stamp}").coalesce(1).write.mode("overwrite").parquet(_folder(path, "partitions", batch_id))
            if batch_id > 1:  # the batch before is committed, so nothing will read these again
                drop(spark, f"{_folder(path, 'windows', batch_id - 2)}/closed=false")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": WATERMARK})).start()


def _partitions(spark: SparkSession, path: str, batch_id: int) -> dict[str | None, dict]:
    if batch_id < 0:
        return {}
    return {r.partition: r.asDict() for r in spark.read.parquet(_folder(path, "partitions", batch_id)).collect()}


def closed_windows(spark: SparkSession, path: str, width: str, keys: Sequence[str], measures: Measures) -> DataFrame:
    """What ``partitioned_windows`` has closed."""
    found = spark.read.parquet(f"{path}/windows").where(F.col("closed") == "true")
    return found.select(F.col("pane").alias("window_start"), (F.col("pane") + interval(width)).alias("window_end"), *keys, *finished(measures))


def put_aside(spark: SparkSession, path: str) -> DataFrame:
    """The late rows, with the watermark that they came behind and the batch that brought them."""
    return spark.read.parquet(f"{path}/late")
