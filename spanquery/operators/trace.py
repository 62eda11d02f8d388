"""Trace trees: roots, orphans, depth and totals for all traces, and one trace as a nested result."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_sum
from ..tables import drop, stored
from .staging import latest_spans

SPAN_CAP = 500


def capped(spans: DataFrame, cap: int = SPAN_CAP) -> DataFrame:
    """The first ``cap`` distinct spans of each trace by time, with ``truncated``."""
    w = Window.partitionBy("trace_id")
    ranked = latest_spans(spans).withColumn("__turn", F.row_number().over(w.orderBy("ts", "span_id")))
    return ranked.withColumn("truncated", F.max("__turn").over(w) >= cap).where(F.col("__turn") <= cap).drop("__turn")


def placed(spans: DataFrame, cap: int | None = None) -> DataFrame:
    """Spans, all or the first ``cap`` of each trace, with is_root and is_orphan: an orphan names a parent that they lack."""
    kept = latest_spans(spans) if cap is None else capped(spans, cap)
    present = kept.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("__found"))
    joined = kept.join(present, ["trace_id", "parent_span_id"], "left")
    missing = F.col("__found").isNull()
    return joined.select(*kept.columns, missing.alias("is_root"), (missing & F.col("parent_span_id").isNotNull()).alias("is_orphan"))


def trace_totals(spans: DataFrame) -> DataFrame:
    """One row a trace, over all its spans: counts of spans, roots, orphans and errors, duration, cost and tokens; truncated is what get_trace says."""
    return placed(spans).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"), F.count_if("is_root").alias("root_count"), F.count_if("is_orphan").alias("orphan_count"),
        (F.count(F.lit(1)) >= SPAN_CAP).alias("truncated"), F.count_if(F.col("status") != "ok").alias("error_count"),
        F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts")).alias("duration_ms"),
        F.round(F.coalesce(exact_sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        (F.coalesce(F.sum("prompt_tokens"), F.lit(0)) + F.coalesce(F.sum("completion_tokens"), F.lit(0))).alias("total_tokens"),
    )


def depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id and depth (roots have 0) of every span that hangs on a root, at any depth.

    Each span knows an ancestor and how far it is; a round gives it that ancestor's ancestor, so the
    distance doubles and n levels take log2(n) rounds.  Spans whose parents form a circle hang on no root.
    """
    spark = spans.sparkSession
    parent = F.when(~F.col("is_root"), F.col("parent_span_id"))
    state, path = stored(placed(spans).select("trace_id", "span_id", parent.alias("up"), F.when(F.col("is_root"), 0).otherwise(1).cast("long").alias("far")), "depths")
    left = state.where("up is not null").count()
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        a = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        turned, new_path = stored(state.join(a, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("up2").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")), "depths")
        drop(spark, path)
        state, path = turned, new_path
        left = state.where("up is not null").count()
    return state.where("up is null").select("trace_id", "span_id", F.col("far").cast("int").alias("depth"))


def get_trace(spans: DataFrame, trace_id: str, cap: int = SPAN_CAP) -> dict[str, Any]:
    """One trace as nested spans with totals, or ``error``; never an empty tree.  At most ``cap`` rows are fetched."""
    try:
        own = spans.sparkSession.sql("select * from {spans} where trace_id = :trace_id", args={"trace_id": trace_id}, spans=spans)
        rows = placed(own, cap).orderBy("ts", "span_id").collect()
    except Exception as failure:  # the contract: a store failure is a result
        return {"error": f"trace store failed: {failure}"}
    if not rows:
        return {"error": f"no trace {trace_id!r}"}
    roots = _nested(rows)
    total = lambda c: sum(getattr(r, c) or 0 for r in rows)
    return {
        "trace_id": trace_id,
        "span_count": len(rows),
        "root_count": len(roots),
        "orphan_count": sum(r.is_orphan for r in rows),
        "truncated": bool(rows[0].truncated),
        "error_count": sum(r.status != "ok" for r in rows),
        "duration_ms": round((max(r.ts for r in rows) - min(r.ts for r in rows)).total_seconds() * 1000, 3),
        "total_cost_usd": round(total("cost_usd"), 6),
        "total_tokens": total("prompt_tokens") + total("completion_tokens"),
        "spans": roots,
    }


def _nested(rows: list) -> list[dict[str, Any]]:
    """Spans with their children below them; a span whose parent is not among them is a root."""
    nodes = {r.span_id: {k: v for k, v in r.asDict().items() if k != "is_root"} | {"children": []} for r in rows}
    roots = []
    for r in rows:
        parent = nodes.get(r.parent_span_id)
        (roots if parent is None or r.parent_span_id == r.span_id else parent["children"]).append(nodes[r.span_id])
    return roots


def lines_of(rows: list) -> list[str]:
    """A line a span, indented by level."""
    return tree_lines({"spans": _nested(rows)})


def tree_lines(trace: dict[str, Any]) -> list[str]:
    """A line a span, indented by level."""
    out: list[str] = []

    def walk(nodes: list[dict], level: int) -> None:
        for n in nodes:
            out.append(f"{'  ' * level}{n['event_type']} {n['span_id'][:8]} {n['status']} {n['latency_ms']:.1f} ms")
            walk(n["children"], level + 1)

    walk(trace.get("spans", []), 0)
    return out
