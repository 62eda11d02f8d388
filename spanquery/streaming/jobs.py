"""Structured Streaming jobs: raw archive, closed windows, dead letters, deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import aggregate_5m
from ..operators.trace import SPAN_CAP, lines_of
from ..schema import SPAN, SPAN_JSON
from ..sources import avro

WATERMARK = "30 seconds"
CONFLUENT_HEADER = 5  # magic byte and schema id before the Avro body


def kafka_source(spark: SparkSession, brokers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Messages of a topic from its earliest offset.  Each query of this frame keeps its own
    offsets in its checkpoint, as an independent consumer would.  Needs the Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest")
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def avro_body(messages: DataFrame) -> DataFrame:
    """The Avro record of each message without the registry's header; NULL where there is no such header."""
    whole = (F.length("value") >= CONFLUENT_HEADER) & (F.substring("value", 1, F.lit(1)) == F.lit(b"\x00"))
    return messages.withColumn("body", F.when(whole, F.substring("value", CONFLUENT_HEADER + 1, F.lit(2**31 - 1))))


def decode_avro(messages: DataFrame, schema: dict) -> DataFrame:
    """Spans of messages in the registry's Avro framing, in the form that ``decode`` gives.

    Spark's Avro functions come in a package that may be absent, so records are read by
    ``sources.avro``, batch by batch; what it cannot read is told in ``error``.
    """
    return decode(avro.to_json(avro_body(messages), schema, "body").withColumn("value", F.coalesce("json", F.when(F.col("value").isNotNull(), F.lit("{")))).drop("json", "body"))


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages of text files, one a line, with the file as topic; stands in for the broker.

    A file of any size is read in splits by many tasks.  A message's offset is where its split begins plus its place in
    the split: greater for later lines of a file, and never the same for two, as a line has a byte at least.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(path).select("value", F.col("_metadata.file_name").alias("topic"), F.col("_metadata.file_block_start").alias("offset"))
    return lines.mapInArrow(_numbered, "value string, topic string, offset long").select("value", "topic", F.lit(0).alias("partition"), "offset")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (value, topic, start of the split) with their place in the split added to its start; the rows of a split come in order."""
    last, seen = None, 0
    for batch in batches:
        starts = batch.column(2).to_numpy()
        topics = batch.column(1).dictionary_encode()
        codes = topics.indices.to_numpy()
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
        if len(starts):
            if last == (batch.column(1)[0].as_py(), starts[0]):
                place[: first[1] if len(first) > 1 else None] += seen
            last, seen = (batch.column(1)[len(starts) - 1].as_py(), starts[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts + place)], names=["value", "topic", "offset"])


def decode(messages: DataFrame) -> DataFrame:
    """Spans of JSON messages; ``error`` says why a message is none and is null for a span."""
    schema = T.StructType([*SPAN_JSON.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    out = messages.withColumn("s", F.from_json("value", schema, options))
    required = [f.name for f in SPAN if not f.nullable]
    missing = F.array_compact(F.array(*[F.when(F.col(f"s.{c}").isNull(), F.lit(c)) for c in required]))
    error = (
        F.when(F.col("value").isNull(), "empty message")
        .when(F.col("s").isNull() | F.col("s._corrupt").isNotNull(), "malformed JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    )
    fields = [F.timestamp_millis("s.ts_epoch_ms").alias("ts") if f.name == "ts_epoch_ms" else F.col(f"s.{f.name}") for f in SPAN_JSON]
    return out.select(*fields, error.alias("error"), F.col("value").alias("raw"), *[c for c in ("topic", "partition", "offset") if c in messages.columns])


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select("topic", "partition", "offset", "raw", "error")


def spans_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is null").drop("error", "raw", "topic", "partition", "offset")


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception:  # no such table yet
        return False


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def refuse_unsafe_start(spark: SparkSession, sink: str, checkpoint: str, force: bool = False) -> None:
    """Refuse to start where the sink has rows but no checkpoint (rows would come twice), or a
    checkpoint has progress but the sink is empty (rows would be lost)."""
    if force:
        return
    has_offsets, has_rows = _exists(spark, f"{checkpoint}/offsets"), _has_rows(spark, sink)
    if has_rows and not has_offsets:
        raise RuntimeError(f"{sink} has rows but {checkpoint} has no progress; resume with its checkpoint or force")
    if has_offsets and not has_rows and _exists(spark, f"{checkpoint}/commits/0"):
        raise RuntimeError(f"{checkpoint} has progress but {sink} is empty; restore the table or force")


def raw_archive(spans: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, force: bool = False) -> StreamingQuery:
    """Append every span once, partitioned by day; the sink's log makes a restart exact."""
    refuse_unsafe_start(spans.sparkSession, path, checkpoint, force)
    out = spans.withColumn("ts_day", F.to_date("ts"))
    return out.writeStream.format("parquet").partitionBy("ts_day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": WATERMARK})).start()


def window_aggregates(spans: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each five-minute group once, when the watermark has passed its end."""
    out = aggregate_5m(spans.withWatermark("ts", WATERMARK))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": WATERMARK})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, over the progress that is kept."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def deduplicated(spans: DataFrame, within: str = WATERMARK) -> DataFrame:
    """Drop replays of a span id that arrive within the watermark."""
    return spans.withWatermark("ts", within).dropDuplicatesWithinWatermark(["span_id"])


def compact(spans: DataFrame) -> DataFrame:
    """Batch deduplication on the sort key of the hot table."""
    return spans.dropDuplicates(["event_type", "model", "ts", "span_id"])


def fan_out(decoded: DataFrame, good: str, bad: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each message goes to exactly one of two tables.

    A batch writes folders named by its id, so a replayed batch overwrites its own output.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            spans_of(batch).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            dead_letters(batch).withColumn("seen_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            batch.unpersist()

    return decoded.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def print_trees(spans: DataFrame, checkpoint: str, say: Callable[[str], None] = print, cap: int = SPAN_CAP, trigger: dict | None = None) -> StreamingQuery:
    """Say each batch's traces as they come, a line a span, indented below the parents that came with it.
    It is for looking on: of a batch, the ``cap`` latest spans are shown and the rest only counted."""

    def one(batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        rows = batch.orderBy(F.desc("ts"), "span_id").limit(cap).select("trace_id", "span_id", "parent_span_id", "event_type", "status", "latency_ms", "ts").collect()
        for line in lines_of(sorted(rows, key=lambda r: (r.trace_id, r.ts, r.span_id))):
            say(line)
        if n > len(rows):
            say(f"... and {n - len(rows)} more")

    return spans.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def supervise(start, attempts: int = 60, wait_s: float = 10.0) -> StreamingQuery:
    """Run ``start()`` to its end, restarting a failed query from its checkpoint."""
    import time

    for left in range(attempts, 0, -1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if left == 1:
                raise
            time.sleep(wait_s)
    raise ValueError("attempts must be positive")
