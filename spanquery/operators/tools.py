"""Calls by name with checked arguments: search_docs, get_trace and query_metrics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, retrieval, trace

#: Argument: (type, needed, what it must be among or between).
ARGUMENTS: dict[str, dict[str, tuple[type, bool, tuple | range | None]]] = {
    "search_docs": {"query": (str, True, None), "k": (int, False, range(1, 51)), "mode": (str, False, retrieval.MODES)},
    "get_trace": {"trace_id": (str, True, None)},
    "query_metrics": {"metric": (str, True, tuple(metrics.METRICS)), "window": (str, True, tuple(metrics.WINDOWS)), "group_by": (str, False, tuple(metrics.GROUPS))},
}


def problem(tool: str, arguments: dict[str, Any]) -> str | None:
    """What is wrong with a call, or None: an unknown tool or argument, a missing one, a wrong type or value."""
    if tool not in ARGUMENTS:
        return f"unknown tool {tool!r}; known: {sorted(ARGUMENTS)}"
    known = ARGUMENTS[tool]
    for name in arguments:
        if name not in known:
            return f"{tool} has no argument {name!r}"
    for name, (kind, needed, values) in known.items():
        if name not in arguments:
            if needed:
                return f"{tool} needs {name!r}"
            continue
        value = arguments[name]
        if not isinstance(value, kind) or isinstance(value, bool):
            return f"{name} must be {kind.__name__}, not {value!r}"
        if kind is str and not value:
            return f"{name} must not be empty"
        if values is not None and value not in values:
            return f"{name} must be {f'{values[0]} to {values[-1]}' if isinstance(values, range) else 'one of ' + ', '.join(values)}, not {value!r}"
    return None


def search_docs(spark: SparkSession, chunks: DataFrame, query: str, k: int = 5, mode: str = "hybrid", embed=retrieval.hash_vector, **more: Any) -> dict[str, Any]:
    """The k best chunks for one question, or ``error``; chunks have doc_id, text and embedding."""
    if found := problem("search_docs", {"query": query, "k": k, "mode": mode}):
        return {"error": found}
    asked = spark.createDataFrame([(0, query)], "query_id long, query string").withColumn("embedding", embed(F.col("query")))
    try:
        rows = retrieval.retrieve(asked, chunks, k, mode, **more).join(chunks.drop("embedding", "score", "rank"), "doc_id").orderBy("rank").drop("query_id").collect()  # k rows
    except Exception as failure:  # the contract: a store failure is a result
        return {"error": f"search failed: {failure}"}
    return {"query": query, "k": k, "mode": mode, "results": [r.asDict() for r in rows]}


def dispatch(tool: str, arguments: dict[str, Any], spark: SparkSession, spans: DataFrame, chunks: DataFrame) -> dict[str, Any]:
    """A call's result; arguments are checked before anything is read."""
    if found := problem(tool, arguments):
        return {"error": found}
    if tool == "search_docs":
        return search_docs(spark, chunks, **arguments)
    if tool == "get_trace":
        return trace.get_trace(spans, **arguments)
    return metrics.query_metrics(spans, **arguments)
