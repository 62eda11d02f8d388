"""Joins and frames over time: as-of joins, previous rows, rolling counts, sessions, hopping and cumulating windows.

A key may hold a large share of all rows, so no window here is over a key alone: rows are dealt out by key and time
bucket, and what a bucket needs of earlier ones (a last row, an open session, the tail of a frame) comes
from a table with a row or so for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEED, RIGHT, LEFT = 0, 1, 2


def bucket_of(ts: str, width: str) -> Column:
    return F.window(ts, width)["start"]


def interval(text: str) -> Column:
    return F.expr(f"interval '{text}'")


def _present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str, take: dict[str, str],
    tie: Sequence[str] = (), within: str | None = None, strict: bool = False, forward: bool = False, bucket: str = "1 hour",
) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` (name on the right: name in the result) of the last row of
    ``right`` that has its keys and is not later; with ``forward``, of the first that is not earlier.

    ``strict`` leaves out rows of the same time, ``within`` those further away.  Rows of the right that share keys
    and time are ordered by ``tie``, the last of which holds.  Rows of the left without a match, or
    with a null key or time, get nulls; rows of the right with a null key or time match nothing.

    Both sides are put in one order in a bucket, where the last row of the right is carried along; at a bucket's
    start stands what earlier buckets carry over.  So there is no range join, and no key is in one task.
    """
    by = [f"__k{i}" for i in range(len(keys))]
    names = [F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]
    order = F.desc if forward else F.asc
    ties = [f"__tie{i}" for i in range(len(tie))]
    found = F.struct(F.col(right_ts).alias("ts"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(take)])
    have = right.where(_present([*keys, right_ts])).select(*names, F.col(right_ts).alias("__t"), *[F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)], found.alias("__found"))
    have = have.withColumn("__bucket", bucket_of("__t", bucket))
    ask = left.where(_present([*keys, ts])).select(*names, F.col(ts).alias("__t"), F.struct(*[F.col(c) for c in left.columns]).alias("__row")).withColumn("__bucket", bucket_of("__t", bucket))

    # what earlier (or, forward, later) buckets carry over to those in which the left has rows
    place = F.struct("__t", *ties)
    last = have.groupBy(*by, "__bucket").agg((F.min_by if forward else F.max_by)("__found", place).alias("__last"), F.lit(False).alias("__asked"))
    asked = ask.select(*by, "__bucket").distinct().select(*by, "__bucket", F.lit(None).cast(last.schema["__last"].dataType).alias("__last"), F.lit(True).alias("__asked"))
    buckets = last.unionByName(asked).groupBy(*by, "__bucket").agg(F.first("__last", True).alias("__last"), F.max("__asked").alias("__asked"))
    before = Window.partitionBy(*by).orderBy(order("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    seeds = buckets.withColumn("__found", F.last("__last", True).over(before)).where("__asked and __found is not null")

    # a seed stands before all of its bucket
    edge = F.col("__bucket") + interval(bucket) if forward else F.col("__bucket")
    parts = [
        seeds.select(*by, "__bucket", edge.alias("__t"), F.lit(SEED).alias("__side"), "__found"),
        have.withColumn("__side", F.lit(RIGHT)),
        ask.withColumn("__side", F.lit(LEFT)),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rank = F.when(F.col("__side") == SEED, 0).when(F.col("__side") == (LEFT if strict else RIGHT), 1).otherwise(2)
    order_in = Window.partitionBy(*by, "__bucket").orderBy(F.col("__side") != SEED, order("__t"), rank, *[order(t) for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__met", F.last("__found", True).over(order_in)).where(F.col("__side") == LEFT)
    met = F.col("__met")
    if within is not None:
        near = (met["ts"] <= F.col("__t") + interval(within)) if forward else (met["ts"] >= F.col("__t") - interval(within))
        met = F.when(near, met)
    taken = [(c, f"c{i}", out) for i, (c, out) in enumerate(take.items())]
    matched = rows.select(*[F.col("__row")[c].alias(c) for c in left.columns], *[met[n].alias(out) for _, n, out in taken])
    alone = left.where(~_present([*keys, ts])).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(out) for c, _, out in taken])
    return matched.unionByName(alone)


def previous(rows: DataFrame, keys: Sequence[str], ts: str, take: dict[str, str], tie: Sequence[str] = (), bucket: str = "1 day") -> DataFrame:
    """Rows with columns ``take`` (name: name in the result) of the row before, in the order of ``ts`` and ``tie`` of
    their key; null for a first row.  A null is a key and a time (the earliest) like any other."""
    rows = rows.withColumn("__bucket", F.window(F.coalesce(ts, F.lit("1970-01-01").cast(rows.schema[ts].dataType)), bucket)["start"])
    values = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(take)])
    place = F.struct(ts, *tie)
    last = rows.groupBy(*keys, "__bucket").agg(F.max_by(values, place).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__bucket")
    carried = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__at"), F.lag("__last").over(over).alias("__carried"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(ts, *tie)
    rows = rows.withColumn("__before", F.lag(values).over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__bucket") == F.col("__at")]
    met = F.coalesce("__before", "__carried")
    return rows.join(carried, same, "left").select(*[F.col(c) for c in rows.columns if not c.startswith("__")], *[met[f"c{i}"].alias(out) for i, out in enumerate(take.values())])


def micros_of(text: str) -> int:
    return int(pd.Timedelta(text) / pd.Timedelta("1us"))


def rolling_counts(rows: DataFrame, keys: Sequence[str], ts: str, within: str, counts: dict[str, Column], spread: int = 4) -> DataFrame:
    """Rows with, for each name, the number of rows of their key that meet a condition and lie at most ``within``
    before them, themselves and others of their time included.  Rows with a null time are not counted and get null.

    A bucket is ``spread`` frames wide; the rows of its last frame are context in the next one, too.
    """
    size = micros_of(within)
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), F.lit(size * spread)
    own, following = F.expr("__at div __width"), F.expr(f"(__at + {size}) div __width")
    homes = F.when(own == following, F.array(own)).otherwise(F.array(own, following))
    dealt = rows.where(F.col(ts).isNotNull()).withColumns({"__at": at, "__width": width}).select("*", F.posexplode(homes).alias("__copy", "__home"))
    frame = Window.partitionBy(*keys, "__home").orderBy("__at").rangeBetween(-size, 0)
    out = dealt.select("*", *[F.count_if(c).over(frame).alias(name) for name, c in counts.items()]).where("__copy = 0").select(*rows.columns, *counts)
    return out.unionByName(rows.where(F.col(ts).isNull()).select("*", *[F.lit(None).cast("long").alias(n) for n in counts]))


#: name: kind (count, total, max or min) and an expression; a count takes a condition, or None for all rows.
Measures = dict[str, tuple[str, str | None]]


def measured(measures: Measures) -> list[Column]:
    """Aggregates that can be merged; totals of doubles are decimals until ``finished``."""
    out = []
    for name, (kind, column) in measures.items():
        c = None if column is None else F.expr(column)
        made = {"count": lambda c=c: F.count(F.lit(1)) if c is None else F.count_if(c), "total": lambda c=c: F.sum(c.cast("decimal(18,6)")), "max": lambda c=c: F.max(c), "min": lambda c=c: F.min(c)}[kind]()
        out.append(made.alias(name))
    return out


def merged(measures: Measures, over: WindowSpec | None = None) -> list[Column]:
    out = []
    for name, (kind, _) in measures.items():
        c = {"count": F.sum, "total": F.sum, "max": F.max, "min": F.min}[kind](name)
        out.append((c if over is None else c.over(over)).alias(name))
    return out


def finished(measures: Measures) -> list[Column]:
    return [F.col(n).cast("double").alias(n) if kind == "total" else F.col(n) for n, (kind, _) in measures.items()]


def panes(rows: DataFrame, keys: Sequence[str], ts: str, width: str, measures: Measures) -> DataFrame:
    """Tumbling groups that wider windows are put together from; rows with a null time are in none."""
    return rows.groupBy(F.window(ts, width)["start"].alias("pane"), *keys).agg(*measured(measures))


def _parts(size: str, step: str) -> int:
    n, rest = divmod(micros_of(size), micros_of(step))
    if rest or not n:
        raise ValueError(f"{size} is no multiple of {step}")
    return n


def hopping(rows: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, measures: Measures) -> DataFrame:
    """Windows of ``size`` that begin every ``slide``, each that holds a row.  Rows are aggregated once, into panes of
    one slide; panes, not rows, go to all the windows that they are part of."""
    _parts(size, slide)
    starts = F.sequence(F.col("pane") - interval(size) + interval(slide), F.col("pane"), interval(slide))
    out = panes(rows, keys, ts, slide, measures).withColumn("window_start", F.explode(starts)).groupBy("window_start", *keys).agg(*merged(measures))
    return out.select("window_start", (F.col("window_start") + interval(size)).alias("window_end"), *keys, *finished(measures))


def cumulating(rows: DataFrame, keys: Sequence[str], ts: str, size: str, step: str, measures: Measures) -> DataFrame:
    """Windows that begin every ``size`` and end at each ``step`` after their start, up to ``size``, each that holds a row.

    Running totals over the panes of a window; a total holds up to the next pane with a row."""
    _parts(size, step)
    base = panes(rows, keys, ts, step, measures).withColumn("window_start", F.window("pane", size)["start"])
    inside = Window.partitionBy("window_start", *keys).orderBy("pane")
    until = F.coalesce(F.lead("pane").over(inside), F.col("window_start") + interval(size))
    running = base.select("window_start", *keys, F.col("pane").alias("__pane"), until.alias("__until"), *merged(measures, inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.sequence(F.col("__pane") + interval(step), F.col("__until"), interval(step))
    return running.select("window_start", F.explode(ends).alias("window_end"), *keys, *finished(measures))


def sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap: str, measures: Measures, bucket: str = "1 day") -> DataFrame:
    """Stretches of a key's rows without a silence longer than ``gap``: session_start, session_end (the last row
    and ``gap``) and measures.  Rows with a null time are in none; a null key is a key.

    Stretches are found in each bucket first; those of a key, a few for each bucket, are then merged where a
    bucket's border has cut them.
    """
    timed = rows.where(F.col(ts).isNotNull()).withColumn("__bucket", bucket_of(ts, bucket))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(ts)
    begins = F.coalesce(F.col(ts) > F.lag(ts).over(inside) + interval(gap), F.lit(True))
    cut = timed.withColumn("__begins", begins.cast("int")).withColumn("__part", F.sum("__begins").over(inside))
    parts = cut.groupBy(*keys, "__bucket", "__part").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), *measured(measures))
    order = Window.partitionBy(*keys).orderBy("__first")
    begins = F.coalesce(F.col("__first") > F.lag("__last").over(order) + interval(gap), F.lit(True))
    whole = parts.withColumn("__begins", begins.cast("int")).withColumn("__session", F.sum("__begins").over(order))
    out = whole.groupBy(*keys, "__session").agg(F.min("__first").alias("session_start"), (F.max("__last") + interval(gap)).alias("session_end"), *merged(measures))
    return out.select(*keys, "session_start", "session_end", *finished(measures))
