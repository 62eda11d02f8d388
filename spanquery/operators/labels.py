"""Label sheets: a stratified sample of a run's answers for people to grade, and what they graded."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evals import stratified_sample

COLUMNS = ("eval_result_id", "example_key", "question", "retrieved_sources", "answer", "human_faithfulness", "human_notes")


def row_digest(rows: list[tuple[int, str, str]]) -> str:
    """SHA-256 of the ids, questions and answers of a sheet; another digest is another sheet."""
    return hashlib.sha256("".join(f"{i}\0{q}\0{a}\0" for i, q, a in sorted(rows)).encode()).hexdigest()


def label_sheet(results: DataFrame, stratum: str, n: int, run: int) -> DataFrame:
    """The sheet's rows in the order of the examples, the same for a run whenever it is made."""
    chosen = stratified_sample(results, stratum, "eval_result_id", n, run)
    blank = F.lit(None).cast("string")
    return chosen.select("eval_result_id", "example_key", "question", "retrieved_sources", "answer", blank.alias("human_faithfulness"), blank.alias("human_notes")).orderBy("example_key")


def write_sheet(sheet: DataFrame, path: str, run: int, **config: object) -> dict:
    """Write the sheet as one CSV file with its manifest beside it, which is returned; a sheet is a few dozen rows."""
    rows = sheet.collect()
    manifest = {"eval_run_id": run, "n": len(rows), "columns": list(COLUMNS), "row_digest": row_digest([(r.eval_result_id, r.question, r.answer or "") for r in rows]), "ids": [r.eval_result_id for r in rows], **config}
    spark = sheet.sparkSession
    sheet.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/sheet")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """eval_result_id and human (1 to 5) of the graded rows; ``ValueError`` for a grade that is no whole number from 1 to 5."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/sheet")
    rows = rows.select(F.col("eval_result_id").cast("long").alias("eval_result_id"), F.trim("human_faithfulness").alias("g")).where("g <> ''")
    graded = rows.select("eval_result_id", "g", F.col("g").try_cast("double").cast("int").alias("human"))
    wrong = graded.where("human is null or human not between 1 and 5").first()
    if wrong is not None:
        raise ValueError(f"row {wrong.eval_result_id}: {wrong.g!r} is no whole number from 1 to 5")
    return graded.select("eval_result_id", "human")


def judged_pairs(spark: SparkSession, path: str, results: DataFrame) -> DataFrame:
    """judge and human grades of the labelled rows that the judge graded, too.  ``ValueError`` if the
    sheet's rows are no longer what the run holds: a judge is not held against answers it never saw."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    now = results.where(F.col("eval_result_id").isin(manifest["ids"])).select("eval_result_id", "question", "answer").collect()
    if row_digest([(r.eval_result_id, r.question, r.answer or "") for r in now]) != manifest["row_digest"]:
        raise ValueError(f"the sheet is not of run {manifest['eval_run_id']} as it now stands")
    return read_labels(spark, path).join(results.select("eval_result_id", F.col("faithfulness").alias("judge")), "eval_result_id").where("judge is not null").select("judge", "human")
