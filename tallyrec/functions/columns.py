"""Expressions on columns."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mapped(column: Column, values: dict, default=None) -> Column:
    """``values[column]``, as a chain of conditions that stays in generated code."""
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def unsent(df: DataFrame) -> DataFrame:
    """``df``, joined by exchanges on both sides and never sent whole to the driver and every task.

    The planner takes a table for as large as its files; a catalogue of repeated values is 20 and more times that in memory,
    and a query that joins it in several places would hold as many copies of it.
    """
    return df.hint("merge")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b``; ``empty`` where ``b`` is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def age(as_of: Column, at: Column, unit_seconds: float) -> Column:
    """How long before ``as_of``, in units; fractional."""
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(unit_seconds * 1e6)


def half_life(age_in_units: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age_in_units / F.lit(half))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def steady_sum(column: Column) -> Column:
    """The sum of numbers below 1e19, the same in whatever order they are added.

    What they hold down to 18 decimals is added exactly; only what is below that is added as doubles, which keeps the smallest
    numbers and is too little to show.  Equal groups thus have equal sums and are ranked by id, not by the order of the tasks.
    """
    exact = column.cast("decimal(38,18)")
    return F.sum(exact).cast("double") + F.sum(column - exact.cast("double"))


def minmax_all(df: DataFrame, column: str, constant: float = 0.0) -> DataFrame:
    """``column`` scaled to 0..1 over the whole frame; a constant becomes ``constant``.

    The bounds come from one aggregate row, so nothing is gathered in one task.
    """
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(constant))
    return df.crossJoin(F.broadcast(bounds)).withColumn(column, scaled).drop("_lo", "_hi")


def minmax_within(column: Column, keys: list[str]) -> Column:
    """Per list: 0..1; a constant list is 1, or 0 if that constant is 0."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return F.when(hi > lo, (column - lo) / (hi - lo)).when(hi == 0, 0.0).otherwise(1.0)


def minmax_groups(df: DataFrame, column: str, key: str, constant: float = 1.0) -> DataFrame:
    """As :func:`minmax_within`, for groups too large for a window: the bounds are aggregated and joined back."""
    bounds = df.groupBy(key).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(F.col("_hi") == 0, 0.0).otherwise(F.lit(constant))
    return df.join(bounds, key).withColumn(column, scaled).drop("_lo", "_hi")


def top_k(df: DataFrame, keys: list[str], score: str, item: str, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` best of each list: score down, item up; ranks from 1.

    Spark keeps at most ``k`` rows a list and task before the exchange.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def stable_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The first eight bytes of SHA-256 as a big-endian number, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the Abramowitz-Stegun approximation 26.2.17 (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def chi_square_tail(x: Column, degrees: Column) -> Column:
    """Chance that a chi-square of so many degrees of freedom is above ``x``: finite sums, for odd degrees from the normal tail on."""
    h = x / 2
    step = lambda shift: lambda s, i: F.struct((s["total"] + s["term"]).alias("total"), (s["term"] * h / (i + shift)).alias("term"))
    terms = lambda n, first, shift: F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(0.0).alias("total"), first.alias("term")), step(shift))["total"]
    even = F.exp(-h) * terms((degrees / 2).cast("int"), F.lit(1.0), 0.0)
    odd = 2 * (1 - normal_cdf(F.sqrt(x))) + F.exp(-h) * terms(((degrees - 1) / 2).cast("int"), F.sqrt(h) / 0.886226925452758, 0.5)
    return F.when(degrees < 1, 1.0).otherwise(F.when(degrees % 2 == 0, even).otherwise(odd))


def poisson_draw(u: Column, mean: Column) -> Column:
    """The Poisson number that ``u`` (0 to 1) stands for, by inversion; beyond a mean of 64 by the normal form with its skewness."""
    # fixed values: how likely at most 0, 1, 2, ... of a Poisson variable of mean 1 are
    upto, term = [], exp(-1.0)
    for n in range(1, 13):
        upto.append((upto[-1] if upto else 0.0) + term)
        term /= n
    one = sum((F.when(u > c, 1.0).otherwise(0.0) for c in upto[1:]), F.when(u > upto[0], 1.0).otherwise(0.0))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(140)),
        F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("upto"), F.lit(0.0).alias("n")),
        lambda s, i: F.struct((s["term"] * mean / i).alias("term"), (s["upto"] + s["term"] * mean / i).alias("upto"), F.when(u > s["upto"], i.cast("double")).otherwise(s["n"]).alias("n")),
    )["n"]
    z = normal_quantile(u)
    large = F.greatest(F.round(mean + F.sqrt(mean) * z + (z * z - 1) / 6), F.lit(0.0))
    return F.when(mean == 1, one).when(mean <= 64, walk).otherwise(large)


def normal_quantile(u: Column) -> Column:
    """Abramowitz-Stegun approximation 26.2.23 (error below 4.5e-4)."""
    t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    # Fixed values of the approximation.
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(u < 0.5, -z).otherwise(z)
