"""A closed vocabulary of operational metrics, and dashboard panels as data.

Both are tables of specifications; one builder turns a specification into a DataFrame.  Counts
are exact distinct span ids, never row counts, so replayed spans do not inflate them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import distinct_if, exact_sum, interpolated, percent_of, quantiles, rounded, with_quantiles
from ..sources.spans import between

WINDOWS = {"5m": 300, "15m": 900, "1h": 3600, "24h": 86400}
GROUPS = {"none": None, "model": "model", "event_type": "event_type", "status": "status"}


def _spans() -> Column:
    return F.count_distinct("span_id")


def _errors() -> Column:
    return distinct_if("span_id", F.col("status") != "ok")


def _token_sum() -> Column:
    return F.sum("prompt_tokens") + F.sum("completion_tokens")


_IDS, _BAD = "count(distinct span_id)", "count(distinct case when status <> 'ok' then span_id end)"
_PERCENT = f"cast(round(cast(100.0D * {_BAD} / greatest({_IDS}, 1) as decimal(28,9)), 3) as double)"


@dataclass(frozen=True)
class Metric:
    """(SQL, name) of aggregates over the spans of a trailing window of {seconds}; ``fixed`` grouping overrides
    the caller's; ``quantiles`` of the latency come next to them."""

    aggregates: tuple[tuple[str, str], ...]
    where: str = "true"
    fixed: str | None = None
    order: str | None = None
    quantiles: tuple[tuple[str, float], ...] = ()


METRICS = {
    "request_rate": Metric(((_IDS, "spans"), (f"{_IDS} / {{seconds}} * 60", "spans_per_min"))),
    "p95_latency": Metric(((_IDS, "spans"),), quantiles=(("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))),
    "error_rate": Metric(((_IDS, "spans"), (_BAD, "errors"), (_PERCENT, "error_rate_pct"))),
    "cost_by_model": Metric(
        (("round(cast(sum(cast(cost_usd as decimal(18,6))) as double), 6)", "cost_usd"), (_IDS, "spans"), ("count(distinct trace_id)", "turns")),
        "model is not null", "model", "cost_usd",
    ),
    "tokens_by_model": Metric(
        (("sum(prompt_tokens)", "prompt_tokens_sum"), ("sum(completion_tokens)", "completion_tokens_sum"), ("sum(prompt_tokens) + sum(completion_tokens)", "total_tokens"), (_IDS, "spans")),
        "model is not null", "model", "total_tokens",
    ),
    "tool_error_rate": Metric(((_IDS, "tool_calls"), (_BAD, "errors"), (_PERCENT, "error_rate_pct")), "event_type = 'TOOL_CALL'"),
}


def _check(metric: str, window: str, group_by: str) -> str | None:
    for kind, value, known in (("metric", metric, METRICS), ("window", window, WINDOWS), ("group_by", group_by, GROUPS)):
        if not isinstance(value, str) or value not in known:
            return f"unknown {kind} {value!r}; known: {sorted(known)}"
    return None


def metric_frame(spans: DataFrame, metric: str, window: str, group_by: str = "none", as_of: dt.datetime | None = None) -> DataFrame:
    """The metric over ts >= as_of - window (no upper bound); ``as_of`` defaults to now."""
    if problem := _check(metric, window, group_by):
        raise ValueError(problem)
    spec, seconds = METRICS[metric], WINDOWS[window]
    since = (dt.datetime.now(dt.UTC).replace(tzinfo=None) if as_of is None else as_of) - dt.timedelta(seconds=seconds)
    kept = between(spans, since, None).where(F.expr(spec.where))
    column = spec.fixed or GROUPS[group_by]
    keys = [column] if column else []
    out = kept.groupBy(*keys).agg(*[F.expr(sql.format(seconds=seconds)).alias(name) for sql, name in spec.aggregates])
    if spec.quantiles:
        found = quantiles(kept, keys, "latency_ms", dict(spec.quantiles))
        found = found.select(*keys, *[rounded(F.col(name), 3).alias(name) for name, _ in spec.quantiles])
        out = with_quantiles(out, found, keys).select(*keys, *[name for name, _ in spec.quantiles], *[name for _, name in spec.aggregates])
    return out.orderBy(F.desc(spec.order) if spec.order else column, column) if column else out


def build_metric_sql(metric: str, window: str, group_by: str = "none", spans: str = "spans") -> str:
    """A metric as a query that runs, with the named parameter :as_of; built from the specifications alone."""
    if problem := _check(metric, window, group_by):
        raise ValueError(problem)
    spec, seconds = METRICS[metric], WINDOWS[window]
    column = spec.fixed or GROUPS[group_by]
    parts = [f"cast(round(cast(percentile(latency_ms, {q}) as decimal(28,9)), 3) as double) as {name}" for name, q in spec.quantiles]
    parts += [f"{sql.format(seconds=seconds)} as {name}" for sql, name in spec.aggregates]
    tail = f" group by {column} order by {spec.order + ' desc, ' if spec.order else ''}{column}" if column else ""
    return f"select {', '.join(([column] if column else []) + parts)} from {spans} where ts >= :as_of - interval {seconds} seconds and {spec.where}{tail}"


def query_metrics(spans: DataFrame, metric: str, window: str, group_by: str = "none", as_of: dt.datetime | None = None) -> dict[str, Any]:
    """Rows of a metric with the text that defines them, or ``error``; an unknown key reads nothing."""
    if problem := _check(metric, window, group_by):
        return {"error": problem}
    try:
        rows = [r.asDict() for r in metric_frame(spans, metric, window, group_by, as_of).collect()]
    except Exception as failure:  # the contract: a store failure is a result, not a number
        return {"error": f"metrics store failed: {failure}"}
    grouping = "none" if METRICS[metric].fixed else group_by
    return {"metric": metric, "window": window, "group_by": grouping, "sql": build_metric_sql(metric, window, group_by), "row_count": len(rows), "rows": rows}


@dataclass(frozen=True)
class Panel:
    """Filter, group (time bucket and dimensions), aggregate, order and limit."""

    title: str
    aggregates: Callable[[int], list[Column]]
    where: str = "true"
    timed: bool = False
    by: tuple[str, ...] = ()
    order: str | None = None
    limit: int | None = field(default=None)
    whole: tuple[tuple[str, float], ...] = ()


def _percent() -> Column:
    return percent_of(_errors(), _spans())


def _rounded(*qs: tuple[str, float]) -> list[Column]:
    return [rounded(interpolated("latency_ms", q), 6).alias(name) for name, q in qs]


def _per_turn(total: Column) -> Column:
    return total / F.greatest(F.count_distinct("trace_id"), F.lit(1))


_LLM, _VERSIONED = "event_type = 'LLM_CALL'", "coalesce(prompt_version, '') <> ''"
_COST = lambda s: [exact_sum("cost_usd").alias("cost_usd")]

PANELS = {
    "spans": Panel("Spans", lambda s: [_spans().alias("spans")]),
    "error_rate": Panel("Error rate", lambda s: [_percent().alias("error_rate_pct")]),
    "cost": Panel("Cost", _COST),
    "p95_llm": Panel("p95 LLM latency", lambda s: [], _LLM, whole=(("p95_ms", 0.95),)),
    "request_rate": Panel("Request rate by event type", lambda s: [(_spans() * 60.0 / s).alias("spans_per_min")], timed=True, by=("event_type",)),
    "llm_latency": Panel("LLM latency p50 / p95 / p99", lambda s: _rounded(("p50", 0.5), ("p95", 0.95), ("p99", 0.99)), _LLM, True),
    "error_rate_series": Panel("Error rate over time", lambda s: [_percent().alias("error_rate_pct")], timed=True),
    "tokens_per_min": Panel("Tokens per minute by model", lambda s: [(_token_sum() * 60.0 / s).alias("tokens_per_min")], "model is not null", True, ("model",)),
    "cost_by_model": Panel("Cost by model", _COST, "model is not null", True, ("model",)),
    "retrieval_latency": Panel("Retrieval latency p50 / p95", lambda s: _rounded(("p50", 0.5), ("p95", 0.95)), "event_type = 'RETRIEVAL'", True),
    "tool_error_rate": Panel("Tool error rate", lambda s: [_percent().alias("tool_error_rate_pct")], "event_type = 'TOOL_CALL'", True),
    "session_cost": Panel(
        "Cost per session", lambda s: [*_COST(s), F.count_distinct("trace_id").alias("turns"), _spans().alias("spans")], by=("session_id",), order="cost_usd", limit=20
    ),
    "prompt_cost": Panel("Cost per turn by prompt version", lambda s: [_per_turn(exact_sum("cost_usd")).alias("cost_per_turn_usd")], _VERSIONED, True, ("prompt_version",)),
    "prompt_tokens": Panel("Tokens per turn by prompt version", lambda s: [_per_turn(_token_sum()).alias("tokens_per_turn")], _VERSIONED, True, ("prompt_version",)),
    "turn_cost": Panel(
        "Turn cost distribution",
        lambda s: [*_COST(s), _token_sum().alias("tokens"), _spans().alias("spans"), F.count_if(F.col("status") != "ok").alias("errors")],
        by=("trace_id",), order="cost_usd", limit=20,
    ),
}


def panel_frame(spans: DataFrame, panel: str, start: dt.datetime, end: dt.datetime, interval_s: int = 3600) -> DataFrame:
    """A panel over start <= ts <= end; ties of a limited panel go to the smaller key."""
    if panel not in PANELS:
        raise ValueError(f"unknown panel {panel!r}; known: {sorted(PANELS)}")
    spec = PANELS[panel]
    kept = between(spans, start, end).where(F.expr(spec.where))
    if spec.whole:  # a quantile over the whole range, not over one interval
        found = quantiles(kept, [], "latency_ms", dict(spec.whole))
        return found.select(*[rounded(F.col(name), 6).alias(name) for name, _ in spec.whole])
    keys = ([F.window("ts", f"{interval_s} seconds")["start"].alias("time")] if spec.timed else []) + [F.col(c) for c in spec.by]
    if not keys:
        return kept.agg(*spec.aggregates(interval_s))
    out = kept.groupBy(*keys).agg(*spec.aggregates(interval_s))
    order = [F.desc_nulls_last(spec.order)] if spec.order else []
    out = out.orderBy(*order, *(["time"] if spec.timed else []), *spec.by)
    return out.limit(spec.limit) if spec.limit else out
