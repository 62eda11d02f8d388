"""Aggregates with fixed definitions.  Sums of doubles go through decimals, so that they do not
depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c: Column | str) -> Column:
    """Sum of a double at six decimals; NULL without values."""
    return F.sum(_col(c).cast("decimal(18,6)")).cast("double")


def rounded(c: Column, digits: int) -> Column:
    """A double rounded half up as a decimal, so that its last bits don't decide a tie; infinite ones, NaN and those
    too large for a decimal stay as they are."""
    return F.when(F.abs(c) < 1e18, F.round(c.cast("decimal(28,9)"), digits).cast("double")).otherwise(c)


def exact_mean(c: Column | str) -> Column:
    """Mean of the non-NULL values from their exact sum."""
    return exact_sum(c) / F.nullif(F.count(_col(c)), F.lit(0))


def nearest_rank(c: Column | str, q: float) -> Column:
    """sorted[max(1, ceil(q n))]: the percentile of the marts."""
    return F.expr(f"percentile_disc({q}) within group (order by {c})") if isinstance(c, str) else F.call_function("percentile_disc", c, F.lit(q))


def interpolated(c: Column | str, q: float) -> Column:
    """Linear interpolation between neighbours: the percentile of metrics and panels."""
    return F.percentile(_col(c), q)


INTERPOLATED, NEAREST_RANK, INDEX = "interpolated", "nearest rank", "index"


def _band(value: Column) -> Column:
    """Sixteen bands for each doubling of a number, in the order of the numbers; infinite ones and NaN, which is
    greater than any, have bands of their own."""
    size = F.when(F.abs(value) == float("inf"), 50_000).otherwise(F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0)) * 16).cast("int") + 20_000)
    return F.when(F.isnan(value), 60_000).when(value > 0, size).when(value < 0, -size).otherwise(0)


def quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], kind: str = INTERPOLATED) -> DataFrame:
    """keys and a column for each name of ``wanted`` (name: share), exact, without any group in one buffer.

    Equal values are counted first.  The counts of bands of values say in which band each wanted
    rank lies; only the values of such a band are then put in order.  A group without values has no row.  Infinite values
    and NaN count as values, NaN as the greatest; between neighbours of which one is infinite lies the infinite one.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*keys, _band(x).alias("__band"), x.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    bands = counts.groupBy(*keys, "__band").agg(F.sum("__n").alias("__m"))
    upto = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumns({"__before": F.coalesce(F.sum("__m").over(upto), F.lit(0)), "__total": F.sum("__m").over(Window.partitionBy(*keys))})

    def ranks(q: float) -> tuple[Column, Column]:
        """The places, from 0, whose values a quantile is made of."""
        last = F.col("__total") - 1
        if kind == NEAREST_RANK:
            place = F.greatest(F.ceil(F.lit(q) * F.col("__total")) - 1, F.lit(0)).cast("long")
            return place, place
        if kind == INDEX:
            place = F.bround(F.lit(q) * last).cast("long")
            return place, place
        return F.floor(F.lit(q) * last).cast("long"), F.ceil(F.lit(q) * last).cast("long")

    places = [F.struct(F.lit(f"{name}{side}").alias("name"), rank.alias("rank")) for name, q in wanted.items() for side, rank in zip("ab", ranks(q), strict=True)]
    inside = F.filter(F.array(*places), lambda p: (p["rank"] >= F.col("__before")) & (p["rank"] < F.col("__before") + F.col("__m")))
    bands = bands.select(*keys, "__band", "__before", "__total", inside.alias("__places")).where(F.size("__places") > 0)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("c.__band") == F.col("b.__band")]
    some = counts.alias("c").join(bands.alias("b"), same).select("c.*", "b.__before", "b.__total", "b.__places")
    order = Window.partitionBy(*keys, "__band").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__n").over(order), F.lit(0)))
    hit = F.filter("__places", lambda p: (p["rank"] >= F.col("__from")) & (p["rank"] < F.col("__from") + F.col("__n")))
    some = some.select(*keys, "__x", "__total", F.explode(F.transform(hit, lambda p: p["name"])).alias("__name"))
    parts = [F.max(F.when(F.col("__name") == f"{name}{side}", F.col("__x"))).alias(f"__{name}{side}") for name in wanted for side in "ab"]
    found = some.groupBy(*keys).agg(F.max("__total").alias("__total"), *parts)

    def value(name: str, q: float) -> Column:
        low, high, at = F.col(f"__{name}a"), F.col(f"__{name}b"), F.lit(q) * (F.col("__total") - 1)
        if kind != INTERPOLATED:
            return low
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, *[value(name, q).alias(name) for name, q in wanted.items()])


def with_quantiles(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Append quantiles to the aggregates of the same groups; NULL where a group had no values."""
    if not keys:
        return rows.join(F.broadcast(found), F.lit(True), "left")  # one row each
    other = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(other, same, "left").drop(*[f"__{k}" for k in keys])


def index_percentile(c: Column | str, q: float) -> Column:
    """sorted[round_half_even(q (n - 1))]: the percentile of evaluation runs; NULL without values."""
    ordered = F.sort_array(F.collect_list(_col(c)))
    return F.get(ordered, F.bround(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def distinct_if(c: Column | str, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, _col(c)))


def percent_of(part: Column, whole: Column) -> Column:
    """100 part / max(whole, 1)."""
    return 100.0 * part / F.greatest(whole, F.lit(1))


def rate(c: Column | str, none_counts_as: bool | None = False) -> Column:
    """Share of true values; NULL counts as given, or is left out when that is None."""
    value = _col(c).cast("int")
    if none_counts_as is not None:
        value = F.coalesce(value, F.lit(int(none_counts_as)))
    return F.avg(value)


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both are present; NULL for fewer than two or a constant series."""
    both = _col(a).isNotNull() & _col(b).isNotNull()
    x, y = F.when(both, _col(a).cast("decimal(18,6)")), F.when(both, _col(b).cast("decimal(18,6)"))
    n = F.count(x).cast("double")
    sx, sy = F.sum(x).cast("double"), F.sum(y).cast("double")
    sxy, sxx, syy = (F.sum(p).cast("double") for p in (x * y, x * x, y * y))
    spread = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0)))
    return F.when(n >= 2, (n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0)))


def kappa(pairs: DataFrame, a: str, b: str, quadratic: bool = False) -> DataFrame:
    """One row with kappa of two raters; NULL for no pair, one category, or no expected disagreement.

    What two independent raters would disagree follows from sums of each rater's categories, so
    no table of all pairs of categories is needed.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if quadratic:
        x, y = F.col("a").cast("decimal(18,6)"), F.col("b").cast("decimal(18,6)")
        sums = [F.sum(e).cast("double").alias(n) for n, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("d", (x - y) * (x - y)))]
        low, high = F.least(F.min("a"), F.min("b")), F.greatest(F.max("a"), F.max("b"))
        facts = both.agg(F.count(F.lit(1)).alias("total"), *sums, (low != high).alias("apart"))
        n = F.col("total").cast("double")
        observed, expected = F.col("d") / n, (n * F.col("xx") + n * F.col("yy") - 2 * F.col("x") * F.col("y")) / (n * n)
    else:
        left, right = (both.groupBy(F.col(c).alias("c")).agg(F.count(F.lit(1)).alias(f"m{c}")) for c in "ab")
        cells = left.join(right, "c", "full").agg(F.coalesce(F.sum(F.col("ma") * F.col("mb")), F.lit(0)).cast("double").alias("same"), (F.count(F.lit(1)) >= 2).alias("apart"))
        facts = both.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("a") != F.col("b")).alias("d")).join(F.broadcast(cells), F.lit(True))  # one row each
        n = F.col("total").cast("double")
        observed, expected = F.col("d") / n, 1 - F.col("same") / (n * n)
    value = F.when(F.col("apart") & (F.col("total") > 0), 1 - observed / F.nullif(expected, F.lit(0.0)))
    return facts.select(F.round(value, 9).alias("kappa"), F.col("total").alias("pairs"))
