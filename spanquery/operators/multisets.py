"""Tables as multisets of rows: differences and intersections by counts, for any number of columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row with how often it is on the left (``n_left``) and on the right; nulls are equal.

    Both sides are counted before the shuffle, so a row that is there a thousand times is one row of it for each task.
    """
    sides = [df.select(*columns, F.lit(a).alias("n_left"), F.lit(b).alias("n_right")) for df, a, b in ((left, 1, 0), (right, 0, 1))]
    return sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def _times(counts: DataFrame, n: str, columns: Sequence[str]) -> DataFrame:
    """Each row as often as ``n`` says, in blocks, so that no row holds an array as long as its count."""
    block = 10_000
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {block}")))
    some = counts.withColumn("__n", F.expr(n).cast("long")).where("__n > 0").withColumn("__block", blocks)
    return some.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block), F.col("__n") - F.col("__block") * block)))).select(*columns)


def except_all(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the left, each as often as it is there more often than on the right."""
    return _times(counted(left, right, columns), "n_left - n_right", columns)


def intersect_all(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of both sides, each as often as it is on the side that has it less often."""
    return _times(counted(left, right, columns), "least(n_left, n_right)", columns)


def archive_difference(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How two archives differ, for each value of ``by``: rows that only one side has (as often as it has more), and rows of both."""
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return counted(left, right, columns).groupBy(*by).agg(
        more("n_left", "n_right").alias("only_left"), more("n_right", "n_left").alias("only_right"), F.sum(F.least("n_left", "n_right")).alias("both"), F.count(F.lit(1)).alias("distinct_rows")
    )
