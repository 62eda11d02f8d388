"""Reconciliations across tables and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_sum
from ..operators import marts


def raw_counts(spans: DataFrame) -> DataFrame:
    """One row: rows, distinct span ids, duplicates, and the first and last time."""
    n, ids = F.count(F.lit(1)), F.count_distinct("span_id")
    return spans.agg(n.alias("raw_rows"), ids.alias("distinct_spans"), (n - ids).alias("duplicates"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def same_counts(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """One row with both row counts and MATCH or MISMATCH."""
    a, b = (t.agg(F.count(F.lit(1)).alias(n)) for t, n in zip((left, right), names, strict=True))
    verdict = F.when(F.col(names[0]) == F.col(names[1]), "MATCH").otherwise("MISMATCH")
    return a.join(F.broadcast(b), F.lit(True)).withColumn("verdict", verdict)


def busiest_session(spans: DataFrame) -> DataFrame:
    """The session with most spans, ties to the larger id, from the mart and from raw spans side by side."""
    top = marts.sessions(spans).orderBy(F.desc("span_count"), F.desc("session_id")).limit(1)
    raw = spans.join(F.broadcast(top.select("session_id")), "session_id", "left_semi").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("raw_spans"), F.count_distinct("trace_id").alias("raw_turns"), F.coalesce(exact_sum("cost_usd"), F.lit(0.0)).alias("raw_cost_usd")
    )
    return top.select("session_id", "span_count", "turn_count", "total_cost_usd").join(raw, "session_id")


def percentile_crosscheck(spans: DataFrame) -> DataFrame:
    """Day and model groups with the exact and the interpolated p95 and their relative difference,
    where both sides count the same calls."""
    exact = marts.model_costs(spans).select("event_day", "model", "calls", "latency_p95_ms")
    hot = spans.where("event_type = 'LLM_CALL'").groupBy(F.col("ts_day").alias("event_day"), "model").agg(
        F.count_distinct("span_id").alias("hot_calls"), F.round(F.percentile("latency_ms", 0.95), 6).alias("hot_p95_ms")
    )
    a, h = exact.alias("a"), hot.alias("h")
    both = a.join(h, (F.col("a.event_day") == F.col("h.event_day")) & F.col("a.model").eqNullSafe(F.col("h.model"))).where("calls = hot_calls")
    diff = F.round((F.col("hot_p95_ms") - F.col("latency_p95_ms")) / F.nullif(F.col("latency_p95_ms"), F.lit(0.0)) * 100, 6)
    return both.select("a.event_day", "a.model", "calls", "latency_p95_ms", "hot_p95_ms", diff.alias("difference_pct"))
