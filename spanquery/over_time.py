"""Registered queries about time and about tables as multisets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import spans, stream_of, write_messages
from .operators import multisets, rollups, similar, temporal
from .operators.temporal import Measures
from .sources.spans import table
from .streaming import stateful
from .tables import new_folder

START = dt.datetime(2024, 1, 1)
COSTS: Measures = {"spans": ("count", None), "errors": ("count", "status = 'error'"), "cost_usd": ("total", "cost_usd"), "latency_max_ms": ("max", "latency_ms")}


def _without_zone(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in rows.schema if f.dataType.simpleString() == "timestamp"})


def asof_prompt_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt version that a session last used, at the time of each of its tool calls."""
    rows = spans(spark, sf_dir)
    calls, used = rows.where("event_type = 'TOOL_CALL'").select("span_id", "session_id", "ts"), rows.where("prompt_version is not null")
    return temporal.as_of(calls, used, ["session_id"], "ts", "ts", {"prompt_version": "prompt_version", "ts": "since"}, tie=["span_id"], bucket="1 day").drop("session_id")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the two models that change over time, derived from parts."""
    i = F.col("p_partkey")
    since = F.lit(str(START)).cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 17).cast("int"))
    return table(spark, sf_dir, "part").select(F.when(i % 2 == 0, "model-small").otherwise("model-large").alias("name"), since.alias("since"), F.col("p_retailprice").alias("usd_per_mtok"))


def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price in force at each model call, if it was set at most six hours before: two keys hold all rows."""
    calls = spans(spark, sf_dir).where("event_type = 'LLM_CALL'").select("span_id", F.col("model").alias("name"), "ts")
    return temporal.as_of(calls, _prices(spark, sf_dir), ["name"], "ts", "since", {"usd_per_mtok": "usd_per_mtok", "since": "since"}, within="6 hours")


def asof_next_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next model call of the session after each retrieval, within two days."""
    rows = spans(spark, sf_dir)
    asked, calls = rows.where("event_type = 'RETRIEVAL'").select("span_id", "session_id", "ts"), rows.where("event_type = 'LLM_CALL'")
    return temporal.as_of(asked, calls, ["session_id"], "ts", "ts", {"span_id": "next_call", "ts": "next_ts"}, tie=["span_id"], within="2 days", strict=True, forward=True, bucket="1 day").drop("session_id", "ts")


def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences in each session: how many spans follow another, the longest and the total time between them."""
    rows = temporal.previous(spans(spark, sf_dir).select("session_id", "span_id", "ts"), ["session_id"], "ts", {"ts": "before"}, ["span_id"])
    gap = F.timestamp_diff("MICROSECOND", "before", "ts")
    return rows.groupBy("session_id").agg(F.count("before").alias("gaps"), F.max(gap).alias("longest_us"), F.sum(gap).alias("total_us"))


def rolling_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and failures of a tool in the hour up to each of its calls."""
    calls = spans(spark, sf_dir).where("event_type = 'TOOL_CALL'").select("span_id", "tool_name", "status", "ts")
    return temporal.rolling_counts(calls, ["tool_name"], "ts", "1 hour", {"calls": F.lit(True), "errors": F.col("status") == "error"}).select("span_id", "calls", "errors")


def agent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a session's spans without a silence of six hours."""
    return temporal.sessions(spans(spark, sf_dir), ["session_id"], "ts", "6 hours", COSTS)


def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.hopping(spans(spark, sf_dir), ["event_type"], "ts", "1 hour", "15 minutes", COSTS)


def cumulating_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals since midnight, at each full hour."""
    return temporal.cumulating(spans(spark, sf_dir), ["event_type"], "ts", "1 day", "1 hour", COSTS)


def span_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, errors and cost for all combinations of type, model and status, in one pass."""
    columns = ["event_type", "model", "status"]
    return rollups.grouping_sets(spans(spark, sf_dir), columns, rollups.cube_sets(columns), COSTS)


def span_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["ts_day", "event_type", "tool_name"]
    return rollups.grouping_sets(spans(spark, sf_dir), columns, rollups.rollup_sets(columns), COSTS)


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of each type of span in a fortnight: exact, and whether sketches of days, merged, come within 5 %."""
    rows, start, end = spans(spark, sf_dir), START + dt.timedelta(days=3), START + dt.timedelta(days=17)
    told = rollups.distinct_over(rollups.distinct_sketches(rows, ["event_type"], "ts", "1 day", "trace_id"), ["event_type"], start, end)
    day = F.col("ts_day")
    exact = rows.where((day >= F.lit(start.date())) & (day < F.lit(end.date()))).groupBy("event_type").agg(F.count_distinct("trace_id").alias("traces"))
    return exact.join(told, "event_type").select("event_type", "traces", (F.abs(F.col("estimate") - F.col("traces")) <= 0.05 * F.col("traces")).alias("close"))


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names were mistyped, by the nearest known name."""
    parts, i = table(spark, sf_dir, "part"), F.col("p_partkey").cast("int")
    name = F.concat_ws(" ", "p_name", "p_type")
    at = i % 11 + 1
    cut = F.concat(F.left(name, at - 1), F.substr(name, at + 1))
    wrong = F.when(i % 5 == 0, name).when(i % 5 == 1, cut).when(i % 5 == 2, F.concat(cut, F.lit("x"))).when(i % 5 == 3, F.concat(F.left(name, at), F.lit("~"), F.substr(name, at + 2))).otherwise(F.concat(F.lit("???"), name))
    rows = parts.select("p_partkey", wrong.alias("told"))
    return similar.nearest_names(rows, parts.select(name.alias("name")), "told", "name").drop("told")


def _two_archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans without their ids, so that rows repeat; and the same with failures gone and model calls twice."""
    rows = spans(spark, sf_dir).select("event_type", "model", "status", "tool_name", "prompt_version")
    other = rows.where("status <> 'error'")
    return rows, other.unionByName(other.where("event_type = 'LLM_CALL'"))


def archive_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_archives(spark, sf_dir)
    return multisets.archive_difference(left, right, left.columns, ["event_type", "status"])


def archive_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_archives(spark, sf_dir)
    return multisets.except_all(left, right, left.columns)


def archive_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_archives(spark, sf_dir)
    return multisets.intersect_all(left, right, left.columns)


def _closed(spark: SparkSession, made: DataFrame, folder: str) -> DataFrame:
    """What a stream has appended when it has read all there is."""
    stateful.append(made, f"{folder}/out", f"{folder}/ckpt", stateful.NOW).awaitTermination()
    return _without_zone(spark.read.schema(made.schema).parquet(f"{folder}/out"))


def stream_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots with the spans that followed within two hours; a root without any, once none can come any more."""
    folder, rows = new_folder(spark, "stream"), spans(spark, sf_dir)
    stream = stream_of(spark, rows, folder)
    roots = stream.where("parent_span_id is null").select(F.col("span_id").alias("root_id"), F.col("ts").alias("root_ts"))
    children = stream.where("parent_span_id is not null").select("span_id", "parent_span_id", "ts")
    return _closed(spark, stateful.interval_join(roots, children, {"root_id": "parent_span_id"}, "root_ts", "ts", "2 hours"), folder).select("root_id", "span_id", "ts")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    return _closed(spark, stateful.session_windows(stream_of(spark, spans(spark, sf_dir), folder), ["session_id"], "ts", "6 hours", COSTS), folder)


def stream_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    return _closed(spark, stateful.hopping_windows(stream_of(spark, spans(spark, sf_dir), folder), ["event_type"], "ts", "1 hour", "15 minutes", COSTS), folder)


def stream_closed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that have ended, some of them without the root that says so."""
    folder = new_folder(spark, "stream")
    rows = spans(spark, sf_dir).where("not (parent_span_id is null and status = 'error')")
    return _closed(spark, stateful.closed_traces(stream_of(spark, rows, folder)), folder)


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of four source partitions in three deliveries by time; one in twenty comes a delivery late, and the
    last partition falls silent after the first ten days."""
    third = F.least(F.expr("datediff(ts, date '2024-01-01') div 10"), F.lit(2))
    late = F.pmod(F.conv(F.substring("span_id", 1, 8), 16, 10).cast("long"), F.lit(20)) == 0
    rows = spans(spark, sf_dir).withColumns({"partition": F.substring("session_id", 2, 9).cast("int") % 4, "third": third})
    rows = rows.where("partition <> 3 or third = 0")
    return rows.withColumn("delivery", F.least(F.col("third") + F.when(late, 1).otherwise(0), F.lit(2)))


def _by_partition(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a job over three deliveries, which is stopped after each and goes on from its checkpoint."""
    folder, rows = new_folder(spark, "stream"), _delivered(spark, sf_dir)
    for n in range(3):
        write_messages(rows.where(F.col("delivery") == n), f"{folder}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        stream = stream.withColumn("partition", F.substring("session_id", 2, 9).cast("int") % 4)
        stateful.partitioned_windows(stream, f"{folder}/out", f"{folder}/ckpt", "partition", ["event_type"], "ts", "5 minutes", COSTS, idle_after=1, trigger=stateful.NOW).awaitTermination()
    return f"{folder}/out"


def stream_partition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute windows that have closed under the watermarks of the source partitions."""
    return _without_zone(stateful.closed_windows(spark, _by_partition(spark, sf_dir), "5 minutes", ["event_type"], COSTS))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that came after their window had closed, with the watermark that they came behind."""
    return _without_zone(stateful.put_aside(spark, _by_partition(spark, sf_dir)).select("span_id", "ts", "watermark", F.col("batch").cast("int").alias("delivery")))


QUERIES = {
    f.__name__: f
    for f in (
        asof_prompt_version, asof_price, asof_next_call, span_gaps, rolling_error_rate, agent_sessions, hopping_windows, cumulating_windows, span_cube, span_rollup, distinct_sketches,
        nearest_names, archive_difference, archive_except_all, archive_intersect_all, stream_parent_child, stream_sessions, stream_hops, stream_closed_traces,
        stream_partition_windows, stream_late_rows,
    )
}
