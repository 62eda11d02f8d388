"""The models as a graph, and the lineage that it declares."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from graphlib import TopologicalSorter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import marts, staging


@dataclass(frozen=True)
class Model:
    """A table made by ``build`` from the named inputs."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]


MODELS = {
    m.name: m
    for m in (
        Model("agg_model_5m", ("spans",), staging.aggregate_5m),
        Model("stg_agg_model_5m", ("agg_model_5m",), staging.stage_aggregates),
        Model("stg_prompt_versions", ("prompt_versions",), staging.latest_versions),
        Model("fct_sessions", ("spans",), marts.sessions),
        Model("fct_model_costs", ("spans",), marts.model_costs),
        Model("fct_tool_reliability", ("spans",), marts.tool_reliability),
        Model("fct_cost_by_prompt", ("spans", "stg_prompt_versions"), marts.cost_by_prompt),
    )
}


def order(models: dict[str, Model] = MODELS) -> list[str]:
    """Model names, each after its inputs."""
    graph = TopologicalSorter({m.name: [i for i in m.inputs if i in models] for m in models.values()})
    return list(graph.static_order())


def build(sources: dict[str, DataFrame], only: list[str] | None = None, models: dict[str, Model] = MODELS) -> dict[str, DataFrame]:
    """Lazy frames of the models (all, or those named and what they need)."""
    wanted = set(only or models)
    for name in reversed(order(models)):
        if name in wanted:
            wanted |= {i for i in models[name].inputs if i in models}
    made = dict(sources)
    for name in order(models):
        if name in wanted:
            missing = [i for i in models[name].inputs if i not in made]
            if missing:
                raise KeyError(f"{name} needs {', '.join(missing)}")
            made[name] = models[name].build(*[made[i] for i in models[name].inputs])
    return {name: made[name] for name in order(models) if name in wanted}


def save(frames: dict[str, DataFrame], database: str = "default") -> None:
    """Write each model as a table, replacing what was there."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def edges(models: dict[str, Model] = MODELS) -> list[tuple[str, str]]:
    """(input, output) pairs."""
    return [(i, m.name) for m in models.values() for i in m.inputs]


def edges_of_sql(statement: str) -> list[tuple[str, str]]:
    """(input, output) pairs of an INSERT INTO ... SELECT job, read from its text: tables that it names after
    FROM and JOIN, but for the names that it gives to subqueries."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", statement, flags=re.S)
    made = {name.lower() for name in re.findall(r"(?:\bwith|,)\s+(\w+)\s+as\s*\(", bare, re.I)}
    pairs = []
    for part in bare.split(";"):
        if out := re.search(r"\binsert\s+(?:into|overwrite)\s+(?:table\s+)?`?([\w.]+)`?", part, re.I):
            names = re.findall(r"\b(?:from|join)\s+(?:table\s*\(\s*\w+\s*\(\s*table\s+)?`?([\w.]+)`?", part, re.I)
            pairs += [(n, out[1]) for n in dict.fromkeys(names) if n.lower() not in made]
    return pairs


def lineage(jobs: DataFrame, name: str = "job", text: str = "statement") -> DataFrame:
    """job, input and output of each edge that the jobs' texts name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, i, o) for n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, o in edges_of_sql(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["job", "input", "output"])

    return jobs.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(run, "job string, input string, output string")


def run_event(job: str, models: dict[str, Model] = MODELS, namespace: str = "spanquery", when: dt.datetime | None = None, kind: str = "COMPLETE") -> dict:
    """An OpenLineage run event of one model."""
    if job not in models:
        raise KeyError(f"no model {job!r}")
    stamp = (when or dt.datetime.now(dt.UTC)).isoformat()
    return {
        "eventType": kind,
        "eventTime": stamp,
        "producer": "spanquery",
        "run": {"runId": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{namespace}/{job}/{stamp}"))},
        "job": {"namespace": namespace, "name": job},
        "inputs": [{"namespace": namespace, "name": i} for i in models[job].inputs],
        "outputs": [{"namespace": namespace, "name": job}],
    }
