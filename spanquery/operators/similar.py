"""Names that are nearly known: the least edit distance, through an index of deletions instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(text: Column, most: int) -> Column:
    """The text and what is left of it without any ``most`` characters or fewer; two texts within that edit distance have one in common."""
    out = F.array(text)
    for _ in range(most):
        shorter = F.transform(out, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))).otherwise(F.array(t)))
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def nearest_names(rows: DataFrame, known: DataFrame, name: str, known_name: str, most: int = 2) -> DataFrame:
    """Each row with ``nearest``, the known name with the least edit distance up to ``most`` (ties to the smaller name),
    and ``distance``; nulls where there is none, as for a null name.

    Distinct names alone are compared, where they share a deletion; a name of n characters has about
    n^most / most of them, so this is for names, not for texts.
    """
    told = lambda df, c, out: df.where(F.col(c).isNotNull()).select(F.col(c).alias(out)).distinct().select(out, F.explode(deletions(F.col(out), most)).alias("__part"))
    met = told(rows, name, "__name").join(told(known, known_name, "__known"), "__part").select("__name", "__known").distinct()
    far = met.withColumn("__far", F.levenshtein("__name", "__known")).where(F.col("__far") <= most)
    best = far.groupBy("__name").agg(F.min(F.struct("__far", "__known")).alias("__best"))
    return rows.join(best, F.col(name) == F.col("__name"), "left").select(*[rows[c] for c in rows.columns], F.col("__best.__known").alias("nearest"), F.col("__best.__far").alias("distance"))
