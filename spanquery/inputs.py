"""What the registered queries read: the span archive of a folder of tables, and streams over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.retrieval import BM25Index
from .sources.spans import as_contract, spans_from_events, table, write_archive
from .tables import drop, new_folder

_archives: dict[tuple[str, str], tuple[str, T.StructType, int]] = {}
_indexes: dict[tuple[str, str], tuple[BM25Index, int]] = {}


def _state(spark: SparkSession, path: str) -> int:
    """A number that changes when files under a path are written, replaced or removed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)))


def archive(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """Path and schema of the span archive of a folder: derived from its events once in an application, and again
    when they have changed.  ``forget`` drops it."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, f"{sf_dir}/events.parquet")
    if key in _archives and _archives[key][2] != state:
        forget(spark, sf_dir)
    if key not in _archives:
        made = spans_from_events(table(spark, sf_dir, "events"))
        path = new_folder(spark, "archive")
        write_archive(made, path)
        _archives[key] = path, T.StructType([f for f in made.schema if f.name != "ts_day"] + [T.StructField("ts_day", T.DateType())]), state
    return _archives[key][:2]


def search_index(spark: SparkSession, sf_dir: str) -> BM25Index:
    """The search index of a folder's documents, with their language as project; kept as the archive is."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, f"{sf_dir}/documents.parquet")
    if key in _indexes and _indexes[key][1] != state:
        _indexes.pop(key)[0].drop()
    if key not in _indexes:
        docs = table(spark, sf_dir, "documents").withColumn("project", F.col("lang"))
        _indexes[key] = BM25Index(docs, keep=["project"]), state
    return _indexes[key][0]


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Drop the archive and the index of a folder, or of all folders that this application has read."""
    for held, release in ((_archives, lambda x: drop(spark, x[0])), (_indexes, lambda x: x[0].drop())):
        for key in [k for k in held if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]:
            release(held.pop(key))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of a folder, read by day and column."""
    path, schema = archive(spark, sf_dir)
    return spark.read.schema(schema).parquet(path)


def write_messages(rows: DataFrame, path: str) -> None:
    """Spans as a stream's source has them, appended to a folder."""
    as_contract(rows).withColumnRenamed("ts_epoch_ms", "ts").drop("attributes").write.mode("append").parquet(path)


def stream_of(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """A stream over spans that are written to a folder first."""
    write_messages(rows, f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
