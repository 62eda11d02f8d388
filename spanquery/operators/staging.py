"""Staging: typed spans, five-minute aggregates and the latest state of prompt versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attribute
from ..functions.stats import exact_sum


def stage_spans(spans: DataFrame) -> DataFrame:
    """Contract spans with ``ts``, the day, unpacked attributes and ``is_error``; one row each."""
    a = F.col("attributes")
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "session_id", "event_type", "model", "prompt_tokens", "completion_tokens",
        "latency_ms", "cost_usd", "status", F.col("ts_epoch_ms").alias("ts"), F.to_date("ts_epoch_ms").alias("ts_day"),
        attribute(a, "name").alias("span_name"), F.coalesce(attribute(a, "tool"), attribute(a, "name")).alias("tool_name"),
        attribute(a, "error_class").alias("error_class"), attribute(a, "prompt_version").alias("prompt_version"),
        (F.col("status") != "ok").alias("is_error"), "attributes",
    )


def aggregate_5m(spans: DataFrame, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Tumbling windows by event type and model; errors here are status 'error' alone."""
    window = F.window(ts, width)
    return (
        spans.groupBy(window.alias("w"), "event_type", "model")
        .agg(
            F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("status") == "error").alias("error_count"),
            F.sum("prompt_tokens").alias("prompt_tokens_sum"), F.sum("completion_tokens").alias("completion_tokens_sum"),
            exact_sum("cost_usd").alias("cost_usd_sum"), exact_sum("latency_ms").alias("latency_sum_ms"), F.max("latency_ms").alias("latency_max_ms"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def stage_aggregates(aggregates: DataFrame) -> DataFrame:
    mean = F.when(F.col("event_count") > 0, F.col("latency_sum_ms") / F.col("event_count"))
    return aggregates.withColumn("window_day", F.to_date("window_start")).withColumn("latency_avg_ms", mean)


def latest_versions(changes: DataFrame) -> DataFrame:
    """Latest state of each id; deleted ids are flagged.  A snapshot read loses a tie on the LSN."""
    order = Window.partitionBy("id").orderBy(
        F.desc_nulls_last("source_lsn"), F.when(F.col("op") == "r", 0).otherwise(1).desc(), F.desc("kafka_offset"), F.desc("ingest_ts")
    )
    last = changes.where(F.col("op").isin("c", "u", "d", "r")).withColumn("recency", F.row_number().over(order)).where("recency = 1")
    return last.select(
        F.col("id").alias("prompt_version_id"), F.col("name").alias("prompt_name"), "version", "template_text", "params_json", "created_at",
        F.col("op").alias("last_op"), (F.col("op") == "d").alias("is_deleted"), F.col("source_lsn").alias("last_source_lsn"),
        F.col("source_ts").alias("last_change_ts"), F.col("kafka_offset").alias("last_kafka_offset"), F.col("ingest_ts").alias("landed_at"),
    )


def latest_spans(spans: DataFrame, key: str = "span_id", ts: str = "ts") -> DataFrame:
    """One row a span id, the earliest; replays of a span drop out."""
    first = Window.partitionBy(key).orderBy(ts, *[c for c in ("trace_id", "status") if c in spans.columns])
    return spans.withColumn("__turn", F.row_number().over(first)).where("__turn = 1").drop("__turn")
