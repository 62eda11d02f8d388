"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..tables import drop, new_folder, shared_folder

__all__ = ["drop", "shared_folder", "stored"]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table as Parquet and read it back, which cuts its lineage; also its path.  Most of what is
    stored are hashes, which no codec makes smaller, so there is none, nor its buffers beside the heap."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
