"""Data-quality checks as data.  A check counts its violations; a report has a row a check."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, WARN = "blocking", "warn"


@dataclass(frozen=True)
class Check:
    """A row-wise condition (``holds``; NULL passes), or one of the named whole-table checks."""

    name: str
    holds: Column | None = None
    severity: str = BLOCK
    mostly: float = 1.0
    unique: tuple[str, ...] = ()
    min_rows: int | None = None
    floor: tuple[str, dt.datetime] | None = None


def not_null(column: str, severity: str = BLOCK, mostly: float = 1.0) -> Check:
    return Check(f"{column} not null", F.col(column).isNotNull(), severity, mostly)


def between(column: str, low: float | None = None, high: float | None = None, severity: str = BLOCK) -> Check:
    holds = F.lit(True)
    if low is not None:
        holds &= F.col(column) >= low
    if high is not None:
        holds &= F.col(column) <= high
    return Check(f"{column} in [{'' if low is None else low}, {'' if high is None else high}]", holds, severity)


def at_least(a: str, b: str, severity: str = BLOCK) -> Check:
    return Check(f"{a} >= {b}", F.col(a) >= F.col(b), severity)


def one_of(column: str, values: tuple, severity: str = BLOCK) -> Check:
    return Check(f"{column} one of {', '.join(map(str, values))}", F.col(column).isin(*values), severity)


def none_of(column: str, values: tuple, severity: str = BLOCK) -> Check:
    return Check(f"{column} none of {', '.join(map(str, values))}", ~F.col(column).isin(*values), severity)


def unique(*columns: str, severity: str = BLOCK) -> Check:
    return Check(f"unique {', '.join(columns)}", unique=columns, severity=severity)


def rows_at_least(n: int, severity: str = BLOCK) -> Check:
    return Check(f"rows >= {n}", min_rows=n, severity=severity)


def fresh(column: str, floor: dt.datetime, severity: str = WARN) -> Check:
    return Check(f"max {column} is fresh", floor=(column, floor), severity=severity)


def expression(name: str, sql: str, severity: str = BLOCK) -> Check:
    return Check(name, F.expr(sql), severity)


def run_suite(table: DataFrame, suite: str, checks: list[Check]) -> DataFrame:
    """suite, check, severity, observed (violations, rows or 0/1) and ok.

    All row-wise and whole-table facts come from one aggregation; each uniqueness check is one more.
    """
    facts, results = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(checks):
        if c.holds is not None:
            facts.append(F.count_if(~F.coalesce(c.holds, F.lit(True))).alias(f"v{i}"))
        elif c.floor:
            column, floor = c.floor
            stale = F.coalesce(F.max(column) < F.lit(floor).cast(table.schema[column].dataType), F.lit(True))
            facts.append(stale.cast("long").alias(f"v{i}"))
    row = table.agg(*facts)
    for i, c in enumerate(checks):
        if c.unique:
            groups = table.groupBy(*c.unique).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
            row = row.join(F.broadcast(groups.agg(F.count(F.lit(1)).alias(f"v{i}"))), F.lit(True))  # one row
    for i, c in enumerate(checks):
        if c.min_rows is not None:
            observed, ok = F.col("n"), F.col("n") >= c.min_rows
        else:
            observed = F.col(f"v{i}")
            ok = observed <= F.col("n") * (1 - c.mostly) if c.holds is not None else observed == 0
        results.append(F.struct(F.lit(suite).alias("suite"), F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), observed.cast("long").alias("observed"), ok.alias("ok")))
    return row.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def suites(freshness_floor: dt.datetime) -> dict[str, list[Check]]:
    """The expectations of the four marts."""
    p95 = [between("latency_p95_ms", 0, 600_000)]
    return {
        "fct_sessions": [
            rows_at_least(1), not_null("session_id"), unique("session_id"), between("total_cost_usd", 0), between("total_tokens", 0),
            between("turn_count", 1), between("duration_ms", 0), at_least("span_count", "turn_count"), fresh("last_span_ts", freshness_floor),
        ],
        "fct_model_costs": [
            rows_at_least(1), not_null("event_day"), between("cost_usd", 0), between("calls", 1), between("total_tokens", 0), *p95,
            at_least("latency_max_ms", "latency_p95_ms"), not_null("model", WARN, 0.99),
        ],
        "fct_tool_reliability": [
            rows_at_least(1), not_null("tool_name"), between("error_rate", 0, 1), between("timeout_rate", 0, 1), between("calls", 1), *p95,
            at_least("error_count", "timeout_count"),
        ],
        "fct_cost_by_prompt": [
            rows_at_least(1), not_null("event_day"), between("calls", 1), between("turns", 1), between("cost_usd", 0), between("total_tokens", 0),
            one_of("prompt_attribution", ("known", "unversioned", "unknown")), at_least("calls", "turns"), none_of("prompt_attribution", ("unknown",), WARN),
        ],
    }


def gate(marts: dict[str, DataFrame], freshness_floor: dt.datetime) -> DataFrame:
    """The report over all suites."""
    return reduce(DataFrame.unionByName, [run_suite(marts[name], name, checks) for name, checks in suites(freshness_floor).items()])


def passed(report: DataFrame) -> bool:
    """Whether no blocking check failed."""
    return report.where(f"severity = '{BLOCK}' and not ok").isEmpty()


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Non-NULL child keys without a parent, with their row counts; grouped before the join."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("orphan")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(F.col(parent_key).alias("orphan")).distinct(), "orphan", "left_anti")


def reconcile(spans: DataFrame, marts: dict[str, DataFrame]) -> DataFrame:
    """Rows of staging against the counts that each mart adds up to; all four, with ``matches``."""
    llm, tool = F.count_if(F.col("event_type") == "LLM_CALL"), F.count_if(F.col("event_type") == "TOOL_CALL")
    wanted = {"fct_sessions": F.count(F.lit(1)), "fct_model_costs": llm, "fct_tool_reliability": tool, "fct_cost_by_prompt": llm}
    one = spans.agg(*[c.alias(m) for m, c in wanted.items()])
    expected = one.unpivot([], list(wanted), "mart", "staging_rows")
    sums = [marts[m].agg(F.coalesce(F.sum("span_count" if m == "fct_sessions" else "calls"), F.lit(0)).alias("mart_rows")).withColumn("mart", F.lit(m)) for m in wanted]
    actual = reduce(DataFrame.unionByName, sums)
    return expected.join(actual, "mart").withColumn("matches", F.col("staging_rows") == F.col("mart_rows"))


def overcounts(aggregates: DataFrame, spans: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Each closed window with its streamed count and the count recomputed from the spans.

    The spans are bucketed by the same windows, so the range join becomes an equi-join.
    """
    raw = spans.groupBy(F.window("ts", width)["start"].alias("window_start"), "event_type", "model").agg(F.count(F.lit(1)).alias("recomputed_count"))
    a, r = aggregates.alias("a"), raw.alias("r")
    keys = (F.col("a.window_start") == F.col("r.window_start")) & (F.col("a.event_type") == F.col("r.event_type")) & F.col("a.model").eqNullSafe(F.col("r.model"))
    return a.join(r, keys, "left").select(
        "a.window_start", "a.event_type", "a.model", F.col("a.event_count").alias("streamed_count"), F.coalesce("r.recomputed_count", F.lit(0)).alias("recomputed_count")
    )


def p95_below_average(model_costs: DataFrame, tool_reliability: DataFrame) -> DataFrame:
    """A heuristic (warn): groups whose p95 is below their mean."""
    pick = lambda t, n: t.select(F.lit(n).alias("mart"), "event_day", "latency_p95_ms", "latency_avg_ms")
    both = pick(model_costs, "fct_model_costs").unionByName(pick(tool_reliability, "fct_tool_reliability"))
    return both.where("latency_p95_ms < latency_avg_ms")
