"""Fact tables at their grain, from staged spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_mean, exact_sum, nearest_rank


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _tokens() -> list[Column]:
    prompt, completion = _zero(F.sum("prompt_tokens")), _zero(F.sum("completion_tokens"))
    return [prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens")]


def _is_error() -> Column:
    return F.col("status") != "ok"


def sessions(spans: DataFrame) -> DataFrame:
    return spans.groupBy("session_id").agg(
        F.count_distinct("trace_id").alias("turn_count"), F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("event_type") == "TOOL_CALL").alias("tool_call_count"), F.count_if(F.col("event_type") == "LLM_CALL").alias("llm_call_count"),
        F.count_if(_is_error()).alias("error_count"), *_tokens(), _zero(exact_sum("cost_usd")).alias("total_cost_usd"),
        F.min("ts").alias("first_span_ts"), F.max("ts").alias("last_span_ts"),
        F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts")).alias("duration_ms"),
    )


def model_costs(spans: DataFrame) -> DataFrame:
    calls = spans.where("event_type = 'LLM_CALL'")
    return calls.groupBy(F.col("ts_day").alias("event_day"), "model").agg(
        F.count(F.lit(1)).alias("calls"), *_tokens(), _zero(exact_sum("cost_usd")).alias("cost_usd"), exact_mean("latency_ms").alias("latency_avg_ms"),
        F.max("latency_ms").alias("latency_max_ms"), nearest_rank("latency_ms", 0.95).alias("latency_p95_ms"), F.count_if(_is_error()).alias("error_count"),
    )


def tool_reliability(spans: DataFrame) -> DataFrame:
    late = F.coalesce((F.col("status") == "timeout") | (F.col("error_class") == "TimeoutError"), F.lit(False))
    n = F.count(F.lit(1))
    calls = spans.where("event_type = 'TOOL_CALL'")
    return calls.groupBy(F.col("ts_day").alias("event_day"), "tool_name").agg(
        n.alias("calls"), F.count_if(_is_error()).alias("error_count"), F.count_if(late).alias("timeout_count"),
        (F.count_if(_is_error()).cast("double") / n).alias("error_rate"), (F.count_if(late).cast("double") / n).alias("timeout_rate"),
        exact_mean("latency_ms").alias("latency_avg_ms"), F.max("latency_ms").alias("latency_max_ms"), nearest_rank("latency_ms", 0.95).alias("latency_p95_ms"),
    )


def prompt_dimension(versions: DataFrame) -> DataFrame:
    """Latest id of each version string."""
    order = Window.partitionBy("version").orderBy(F.desc_nulls_last("last_source_lsn"), F.desc("prompt_version_id"))
    ranked = versions.where("version is not null").withColumn("recency", F.row_number().over(order))
    return ranked.where("recency = 1").select("prompt_version_id", "prompt_name", "version", "is_deleted")


def cost_by_prompt(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """LLM calls are aggregated first, so the join to the dimension cannot fan out."""
    calls = spans.where("event_type = 'LLM_CALL'")
    by_prompt = calls.groupBy(F.col("ts_day").alias("event_day"), "prompt_version").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("trace_id").alias("turns"), *_tokens(), _zero(exact_sum("cost_usd")).alias("cost_usd"),
        F.count_if(_is_error()).alias("error_count"), exact_mean("latency_ms").alias("latency_avg_ms"), F.max("latency_ms").alias("latency_max_ms"),
    )
    dim = prompt_dimension(versions)
    joined = by_prompt.join(dim, by_prompt["prompt_version"] == dim["version"], "left")
    attribution = F.when(F.col("prompt_version").isNull(), "unversioned").when(F.col("version").isNull(), "unknown").otherwise("known")
    return joined.select(
        "event_day", "prompt_version", "prompt_version_id", "prompt_name", F.col("is_deleted").alias("prompt_is_deleted"), attribution.alias("prompt_attribution"),
        "calls", "turns", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", (F.col("cost_usd") / F.col("turns")).alias("cost_per_turn_usd"),
        "error_count", "latency_avg_ms", "latency_max_ms",
    )


def model_counters(spans: DataFrame) -> DataFrame:
    """Requests, errors, tokens and cost by model, errors included."""
    return spans.where("model is not null").groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(_is_error()).alias("errors"), *_tokens(), _zero(exact_sum("cost_usd")).alias("cost_usd")
    )
