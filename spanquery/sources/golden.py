"""Golden sets: one YAML or JSON file a project, and their rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

GOLDEN = (
    "key string, project string, question string, expected_answer string, expected_sources array<string>, written_from string, difficulty string, "
    "type string, ci boolean, answerable boolean, tags array<string>"
)

def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:  # JSON is YAML, too
        return json.loads(text)
    return yaml.safe_load(text) or {}


def rows_of(text: str, dataset_version: str) -> list[tuple]:
    """Rows of one file, texts stripped; the file must be of the version asked for."""
    doc = _parsed(text)
    if str(doc.get("dataset_version", "")) != dataset_version:
        raise ValueError(f"the file is of version {doc.get('dataset_version')!r}, not {dataset_version!r}")
    project, out = str(doc.get("project", "")).strip(), []
    for e in doc.get("examples") or ():
        line = {name: str(e.get(name, "")).strip() for name in ("key", "question", "expected_answer", "written_from", "difficulty", "type")}
        sources, tags = ([str(v).strip() for v in e.get(name) or ()] for name in ("expected_sources", "tags"))
        out.append((line["key"], project, line["question"], line["expected_answer"], sources, line["written_from"], line["difficulty"], line["type"], bool(e.get("ci", False)), bool(e.get("answerable", True)), tags))
    return out


def load_golden(spark: SparkSession, folder: str, dataset_version: str) -> DataFrame:
    """All examples of a folder's files; a golden set is written by hand and small.  ``evals.golden_violations`` tells what is wrong in it."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{yaml,yml,json}").text(folder).collect()
    return spark.createDataFrame([row for f in files for row in rows_of(f.value, dataset_version)], GOLDEN)
