"""Key-wise merges of tables without MERGE: classify, merge, delete, and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def classify(existing: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys with change: inserted, updated, unchanged, or orphan (only in ``existing``)."""
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in compared], F.lit(True).alias("__old"))
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in compared], F.lit(True).alias("__new"))
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compared], F.lit(True))
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "orphan").when(same, "unchanged").otherwise("updated")
    return old.join(new, keys, "full").select(*keys, change.alias("change"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows of their keys; orphans stay."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.select(existing.columns))


def upsert_changed(existing: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str]) -> tuple[DataFrame, DataFrame]:
    """The merged table, in which an incoming row that changes nothing leaves the old one as it is, and
    the rows that were written: keys and change, inserted or updated."""
    written = classify(existing, incoming, keys, compared).where("change in ('inserted', 'updated')")
    return upsert(existing, incoming.join(written.select(*keys), keys, "left_semi"), keys), written


def insert_returning(table: DataFrame, rows: DataFrame, order: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with new rows under the next ids, in the order of ``order``, and those rows with their ids.

    The rows are sorted over all tasks and stored with the task's number; what the tasks before have is added to a row's place in its own."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("last"))
    sorted_, _ = stored(rows.orderBy(order).withColumn("__task", F.spark_partition_id()), "returning")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = sorted_.groupBy("__task").agg(F.count(F.lit(1)).alias("__n")).select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    numbered = sorted_.withColumn("__turn", F.row_number().over(Window.partitionBy("__task").orderBy(order))).join(starts, "__task").join(F.broadcast(last), F.lit(True))
    made = numbered.withColumn(key, (F.col("last") + F.col("__from") + F.col("__turn")).cast(table.schema[key].dataType)).select(table.columns)
    return table.unionByName(made), made


def finish(runs: DataFrame, run: int, total_cost_usd: float, at: Column | None = None) -> DataFrame:
    """Runs with one marked as finished."""
    own = F.col("id") == run
    stamp = (F.current_timestamp() if at is None else at).cast(runs.schema["finished_at"].dataType)
    return runs.withColumns({"finished_at": F.when(own, stamp).otherwise(F.col("finished_at")), "total_cost_usd": F.when(own, F.lit(total_cost_usd)).otherwise(F.col("total_cost_usd"))})


def missing_and_stale(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Ids to add (missing) and to delete (stale)."""
    a, b = existing.select(key).distinct(), wanted.select(key).distinct()
    missing = b.join(a, key, "left_anti").select(key, F.lit("missing").alias("state"))
    return missing.unionByName(a.join(b, key, "left_anti").select(key, F.lit("stale").alias("state")))


def hash_skip(stored: DataFrame, fetched: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fetched documents with action skip (content hash unchanged) or ingest."""
    new = fetched.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"))
    old = stored.select(key, F.col("content_hash").alias("__hash"))
    action = F.when(F.col("content_hash").eqNullSafe(F.col("__hash")), "skip").otherwise("ingest")
    return new.join(old, key, "left").select(key, "content_hash", action.alias("action"))
