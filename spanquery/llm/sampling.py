"""Folds by key, and bounded fits: the first rows of a table in an order that depends on keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def first_keys(rows: DataFrame, most: int) -> tuple[DataFrame, object, int]:
    """Which rows are the first ``most`` by (xxhash64(k), k): a table of the keys (column k) that take part
    with all their rows, at most ``most``; the key that takes part with some of its rows, and how many (None, 0 if there is none)."""
    spark = rows.sparkSession
    got = [r.k for r in rows.select("k").orderBy(F.xxhash64("k"), "k").limit(most).collect()]
    whole, last, taken = dict.fromkeys(got), None, 0
    if got:
        taken = sum(k == got[-1] for k in got)
        if rows.where(F.col("k") == F.lit(got[-1])).count() > taken:
            last = got[-1]
            del whole[last]
        else:
            taken = 0
    return spark.createDataFrame([(k,) for k in whole], rows.select("k").schema), last, taken
