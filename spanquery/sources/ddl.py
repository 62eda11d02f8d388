"""Tables of the engine: created if absent, recreated, or told as statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..schema import CHANGE, SPAN

WRITE = {"parquet.block.size": str(8 << 20), "parquet.compression": "zstd"}


@dataclass(frozen=True)
class Table:
    name: str
    fields: T.StructType
    partitioned_by: tuple[str, ...] = ()

    def statement(self, database: str) -> str:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.fields)
        parts = f" partitioned by ({', '.join(self.partitioned_by)})" if self.partitioned_by else ""
        options = ", ".join(f"'{k}' = '{v}'" for k, v in WRITE.items())
        return f"create table if not exists {database}.{self.name} ({columns}) using parquet{parts} tblproperties ({options})"


_DAY = T.StructField("ts_day", T.DateType())
TABLES = (
    Table("trace_events", T.StructType([*SPAN.fields, _DAY]), ("ts_day",)),
    Table(
        "agg_model_5m",
        T.StructType(
            [T.StructField(n, T.TimestampType()) for n in ("window_start", "window_end")]
            + [T.StructField(n, T.StringType()) for n in ("event_type", "model")]
            + [T.StructField(n, T.LongType()) for n in ("event_count", "error_count", "prompt_tokens_sum", "completion_tokens_sum")]
            + [T.StructField(n, T.DoubleType()) for n in ("cost_usd_sum", "latency_sum_ms", "latency_max_ms")]
        ),
    ),
    Table("prompt_version_changes", CHANGE),
)


def create_tables(spark: SparkSession, database: str = "default", recreate: bool = False, dry_run: bool = False, tables: tuple[Table, ...] = TABLES) -> list[tuple[str, str]]:
    """(table, outcome): created, exists, recreated, or with ``dry_run`` the statement, which is then not run.

    ``recreate`` drops a table with its data first; for resetting a workplace only.
    """
    out = []
    if not dry_run:
        spark.sql(f"create database if not exists {database}")
    for t in tables:
        if dry_run:
            out.append((t.name, t.statement(database)))
            continue
        there = spark.catalog.tableExists(f"{database}.{t.name}")
        if there and recreate:
            spark.sql(f"drop table {database}.{t.name}")
        spark.sql(t.statement(database))
        out.append((t.name, "recreated" if there and recreate else "exists" if there else "created"))
    return out
