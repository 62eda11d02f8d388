"""Span sources: the adapter over ``events``, the day-partitioned archive, and synthetic spans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_from_events(events: DataFrame) -> DataFrame:
    """Spans derived from user events: three consecutive events of a user are one turn.

    The first event of a turn is the root, the others are its children.  Both windows use the
    same distribution by user, so the derivation costs one shuffle.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    base = events.select("event_id", "ts", "user_id", F.col("event_type").alias("et"), "value", k.alias("k"), F.row_number().over(by_user).alias("rn"))
    base = base.withColumn("turn_start", F.col("rn") - (F.col("rn") - 1) % 3).withColumn("span_id", F.md5(F.col("event_id").cast("string").cast("binary")))
    root = F.first("span_id").over(Window.partitionBy("user_id", "turn_start").orderBy("rn"))
    buys, fails = F.col("et") == "purchase", F.col("et") == "error"
    prompt, completion = 180 + 2 * F.col("k"), 40 + F.col("k")
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "LLM_CALL", "click", "TOOL_CALL", "error", "TOOL_CALL", "view", "RETRIEVAL")])
    return base.select(
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("turn_start").cast("string")).cast("binary")).alias("trace_id"),
        "span_id",
        F.when(F.col("rn") != F.col("turn_start"), root).alias("parent_span_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.coalesce(F.try_element_at(kinds, F.col("et")), F.lit("AGENT_STEP")).alias("event_type"),
        F.when(buys, F.when(F.col("k") % 2 == 0, "model-small").otherwise("model-large")).alias("model"),
        F.when(buys, prompt).alias("prompt_tokens"),
        F.when(buys, completion).alias("completion_tokens"),
        F.col("value").alias("latency_ms"),
        F.when(buys, (prompt + completion * 5).cast("double") / 1_000_000).alias("cost_usd"),
        F.when(fails, "error").when(buys & (F.col("k") % 10 == 7), "degraded").otherwise("ok").alias("status"),
        "ts",
        F.to_date("ts").alias("ts_day"),
        F.when(F.col("et").isin("click", "error"), F.concat(F.lit("tool_"), (F.col("k") % 4).cast("string"))).otherwise(F.lower("et")).alias("tool_name"),
        F.when(fails, F.when(F.col("k") % 2 == 0, "TimeoutError").otherwise("ValueError")).alias("error_class"),
        F.when(buys & (F.col("k") % 5 != 0), F.concat(F.lit("v"), (F.col("k") % 4 + 1).cast("string"))).alias("prompt_version"),
    )


def as_contract(spans: DataFrame) -> DataFrame:
    """The thirteen contract fields, with the extension facts in ``attributes``."""
    facts = {"name": "tool_name", "tool": "tool_name", "error_class": "error_class", "prompt_version": "prompt_version"}
    attributes = F.map_filter(F.create_map(*[x for k, c in facts.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "session_id", "event_type", "model", "prompt_tokens", "completion_tokens",
        "latency_ms", "cost_usd", "status", F.col("ts").cast("timestamp").alias("ts_epoch_ms"), attributes.alias("attributes"),
    )


def write_archive(spans: DataFrame, path: str, mode: str = "append", max_records: int = 2_000_000) -> None:
    """Parquet by day; one shuffle by ranges of time, so that a file holds a stretch of one day or of few and
    a large day is many files.  Within a file, rows of a kind and model lie together."""
    ts = "ts_epoch_ms" if "ts_epoch_ms" in spans.columns else "ts"
    out = spans.withColumn("ts_day", F.to_date(ts)).repartitionByRange("ts_day", ts).sortWithinPartitions("ts_day", "event_type", "model", ts)
    out.write.mode(mode).option("maxRecordsPerFile", max_records).option("parquet.block.size", 8 << 20).partitionBy("ts_day").parquet(path)


def between(spans: DataFrame, start: dt.datetime | None, end: dt.datetime | None, ts: str = "ts", closed: bool = True) -> DataFrame:
    """Spans from ``start`` to ``end``, ``end`` included if ``closed``; whole days are ruled out by ``ts_day``, where there is one."""
    kind, days = spans.schema[ts].dataType, "ts_day" in spans.columns
    if start is not None:
        spans = spans.where(F.col(ts) >= F.lit(start).cast(kind))
        spans = spans.where(F.col("ts_day") >= F.lit(start.date())) if days else spans
    if end is not None:
        last = F.lit(end).cast(kind)
        spans = spans.where(F.col(ts) <= last if closed else F.col(ts) < last)
        spans = spans.where(F.col("ts_day") <= F.lit(end.date())) if days else spans
    return spans


def read_archive(spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Spans with start <= time < end; the day predicate is derived, so whole partitions are pruned."""
    return between(spark.read.parquet(path), start, end, "ts_epoch_ms", closed=False)


def latest(spans: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The n latest spans, ties to the smaller id; the limit is the feature."""
    return spans.orderBy(F.desc(ts), "span_id").limit(n)


def expire(spark: SparkSession, path: str, as_of: dt.date, days: int = 7) -> list[str]:
    """Drop the day partitions older than ``days``; returns what was dropped."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit, gone = (as_of - dt.timedelta(days=days)).isoformat(), []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("ts_day=") and name[7:] < limit:
            fs.delete(status.getPath(), True)
            gone.append(name[7:])
    return sorted(gone)


def delete_spans(spark: SparkSession, path: str, condition: Column, out: str) -> DataFrame:
    """Rewrite an archive without the rows that meet a condition."""
    kept = spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False)))
    kept.write.mode("overwrite").partitionBy("ts_day").parquet(out)
    return spark.read.parquet(out)


BAD_ID = "0" * 29 + "bad"


def with_bad_row(spans: DataFrame, cost_usd: float = -1.0) -> DataFrame:
    """Spans and an impossible one, a model call of a negative cost, by which a gate is seen to go red; ``delete_spans`` takes it out again."""
    model = spans.where("event_type = 'LLM_CALL'").orderBy("span_id").limit(1)
    return spans.unionByName(model.withColumns({"span_id": F.lit(BAD_ID), "cost_usd": F.lit(cost_usd)}))


def synthetic(spark: SparkSession, turns: int, seed: int = 42, start: str = "2026-01-01 00:00:00", error_percent: int = 8) -> DataFrame:
    """Seeded spans: a good turn is a step, a retrieval and a model call; a failed one a step and a tool call."""
    draw = lambda salt, n: F.pmod(F.xxhash64("turn", F.lit(seed), F.lit(salt)), F.lit(n))
    base = spark.range(turns).select(F.col("id").alias("turn")).withColumn("bad", draw("bad", 100) < error_percent)
    kinds = F.when(F.col("bad"), F.array(F.lit("AGENT_STEP"), F.lit("TOOL_CALL"))).otherwise(F.array(F.lit("AGENT_STEP"), F.lit("RETRIEVAL"), F.lit("LLM_CALL")))
    rows = base.select("turn", "bad", F.posexplode(kinds).alias("pos", "event_type"))
    ident = lambda pos: F.md5(F.concat_ws(":", F.lit(seed), "turn", pos).cast("binary"))
    llm, failed = F.col("event_type") == "LLM_CALL", F.col("bad") & (F.col("event_type") == "TOOL_CALL")
    prompt, completion = 180 + draw("prompt", 241), 40 + draw("completion", 121)
    return rows.select(
        F.md5(F.concat_ws(":", F.lit(seed), "turn").cast("binary")).alias("trace_id"),
        ident(F.col("pos")).alias("span_id"),
        F.when(F.col("pos") > 0, ident(F.lit(0))).alias("parent_span_id"),
        F.concat(F.lit("s"), F.floor(F.col("turn") / 5).cast("string")).alias("session_id"),
        "event_type",
        F.when(llm, "model-small").alias("model"),
        F.when(llm, prompt).alias("prompt_tokens"),
        F.when(llm, completion).alias("completion_tokens"),
        (draw("latency", 5000) / 10 + F.col("pos")).alias("latency_ms"),
        F.when(llm, (prompt + completion * 5) / 1_000_000).alias("cost_usd"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("turn") * 10 + F.col("pos"))).alias("ts_epoch_ms"),
        F.map_filter(
            F.create_map(
                F.lit("name"), F.lower("event_type"),
                F.lit("error_class"), F.when(failed, "TimeoutError"),
                F.lit("prompt_version"), F.when(llm, F.concat(F.lit("v"), (draw("version", 3) + 1).cast("string"))),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("attributes"),
    )
