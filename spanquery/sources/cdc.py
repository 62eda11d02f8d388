"""Change data capture: envelopes to typed change rows, landing, and the seed changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bad_timestamp, parse_timestamp

_ROW = "struct<id: bigint, name: string, version: string, template_text: string, params_json: string, created_at: string>"
_ENVELOPE = f"struct<op: string, before: {_ROW}, after: {_ROW}, source: struct<lsn: bigint, txId: bigint, snapshot: string, ts_ms: bigint>, ts_ms: bigint>"


def parse_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Change rows of JSON envelopes, with ``skipped``: null for a row to land, else why not.

    Tombstones (null values), truncations and messages are skipped, as are rows whose created_at cannot
    be read; a delete takes its row from ``before``.  ``raw`` has kafka_partition, kafka_offset, ingest_ts and the envelope text.
    """
    parsed = raw.withColumn("e", F.from_json(value, _ENVELOPE))
    row = F.when(F.col("e.op") == "d", F.col("e.before")).otherwise(F.col("e.after"))
    skipped = (
        F.when(F.col(value).isNull(), "tombstone")
        .when(F.col("e").isNull() | F.col("e.op").isNull(), "malformed")
        .when(F.col("e.op").isin("t", "m"), F.concat(F.lit("op "), F.col("e.op")))
        .when(~F.col("e.op").isin("c", "u", "d", "r"), "unknown op")
        .when(row.isNull() | row["id"].isNull(), "no row image")
        .when(bad_timestamp(row["created_at"]), "bad timestamp")
    )
    return parsed.withColumn("r", row).select(
        F.col("e.op").alias("op"), F.col("e.source.lsn").alias("source_lsn"), F.col("e.source.txId").alias("source_tx_id"),
        F.col("e.source.snapshot").alias("source_snapshot"), F.timestamp_millis("e.source.ts_ms").alias("source_ts"),
        F.timestamp_millis("e.ts_ms").alias("event_ts"), "ingest_ts", "kafka_partition", "kafka_offset", "r.id", "r.name", "r.version",
        "r.template_text", "r.params_json", parse_timestamp(F.col("r.created_at")).alias("created_at"), F.col(value).alias("envelope_json"), skipped.alias("skipped"),
    )


def land(raw: DataFrame, path: str, checkpoint: str, value: str = "value") -> dict[str, int]:
    """Drain a stream of envelopes into a change table; rows per outcome.

    The source's own option (files or offsets a trigger) bounds a batch.  The write of a micro-batch
    and its offsets are tied by the batch id, so a replayed batch overwrites its own folder instead of
    appending twice.
    """
    seen: dict[str, int] = {}

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = parse_envelopes(batch, value)
        rows.where("skipped is null").drop("skipped").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for r in rows.groupBy(F.coalesce("skipped", F.lit("landed")).alias("k")).count().collect():  # a row an outcome
            seen[r.k] = seen.get(r.k, 0) + r["count"]

    query = raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def changelog_columns() -> str:
    return "op, id, name, version, template_text, source_lsn, source_snapshot, kafka_offset"


#: A snapshot of three versions, an update, a delete, and the cases that test the
#: order of changes (a replay, a change without LSN, a tie, a version recreated under a new id).
CHANGES = [
    ("r", 1, "assistant", "v1", "Answer the question.", 1000, "first", 0),
    ("r", 2, "assistant", "v2", "Answer with the tools at hand.", 1000, "true", 1),
    ("r", 3, "assistant", "v3", "Answer from the manuals.", 1000, "last", 2),
    ("u", 2, "assistant", "v2", "Answer with the tools at hand and name your sources.", 2000, None, 3),
    ("d", 1, "assistant", "v1", "Answer the question.", 3000, None, 4),
    ("u", 2, "assistant", "v2", "Answer with the tools at hand and name your sources.", 2000, None, 3),
    ("u", 3, "assistant", "v3", "A change without a log position.", None, None, 5),
    ("r", 4, "assistant", "v5", "Read by the snapshot.", 1500, "true", 7),
    ("u", 4, "assistant", "v5", "Updated at the same position.", 1500, None, 6),
    ("c", 5, "assistant", "v2", "Recreated under a new id.", 2500, None, 8),
]


def values_sql(rows: list[tuple] = CHANGES) -> str:
    """The changelog as a VALUES list that Spark and other engines read alike."""
    text = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") as t({changelog_columns()})"


def seed_changes(spark: SparkSession, rows: list[tuple] = CHANGES) -> DataFrame:
    out = spark.createDataFrame(rows, "op string, id long, name string, version string, template_text string, source_lsn long, source_snapshot string, kafka_offset long")
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return out.withColumns(
        {"source_tx_id": F.lit(None).cast("long"), "source_ts": stamp, "event_ts": stamp, "ingest_ts": stamp, "kafka_partition": F.lit(0), "params_json": F.lit("{}"), "created_at": stamp}
    )
