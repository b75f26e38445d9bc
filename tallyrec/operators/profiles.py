"""Daily sketches that stand for the rows: quantiles for drift, distinct users for audiences.

A day is read once and kept as one row for each feature (KLL quantiles, count, sum) or slice (theta sketch).  Any window is
a merge of its days, so a comparison reads profiles only, whatever the rows were.

Errors.  A KLL sketch of ``k`` places a value's rank within about ``2.3 / k ** 0.91`` of the truth (99 of 100 times; ``K`` gives
0.25 %), merged or not; a share of PSI or a gap of KS is off by at most twice that.  A theta sketch of ``2 ** lg`` entries is exact up to
about half so many users and has a relative standard error of ``1 / sqrt(2 ** lg)`` beyond (``LG`` gives 0.8 %).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrec.operators.drift import FLOOR, ks_p_value, severity

K, LG = 1800, 14
#: Steps in which a sketch's distribution is read.
STEPS = 500
#: What the drift check watches.  Fixed values.
USER_WATCH = ("total_events", "total_purchases", "avg_purchase_price", "price_sensitivity", "days_since_last_event", "category_concentration", "view_to_purchase_rate")
PRODUCT_WATCH = ("price", "popularity_score", "conversion_rate", "view_count_30d", "quality_score", "days_since_release")


def rank_error(k: int = K) -> float:
    """How far a rank may be off, 99 of 100 times."""
    return 2.3 / k**0.91


def daily_profiles(frame: DataFrame, features: list[str] | tuple[str, ...], day: str = "day", k: int = K) -> DataFrame:
    """``day, feature, sketch, n, total`` of the columns ``features``; nulls and NaN are no values."""
    days = frame.select(F.col(day).cast("int").alias("day"), *features)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    rows = days.select("day", F.explode(pairs).alias("p")).select("day", "p.*").filter("value is not null and not isnan(value)")
    return rows.groupBy("day", "feature").agg(F.kll_sketch_agg_double("value", k).alias("sketch"), F.count("value").alias("n"), F.sum("value").alias("total"))


def window_profile(profiles: DataFrame, first: int, last: int) -> DataFrame:
    """``feature, sketch, n, total`` of the days ``first`` to ``last``."""
    return profiles.filter(F.col("day").between(first, last)).groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def _quantiles(sketch: str, ranks: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in ranks]))


def _shares(values: str, points: Column, inclusive: bool = False) -> Column:
    """Share of ``values`` under each point, or up to it."""
    n = F.size(values).cast("double")
    return F.transform(points, lambda x: F.size(F.filter(values, (lambda v: v <= x) if inclusive else (lambda v: v < x))) / n)


def compare_profiles(reference: DataFrame, current: DataFrame, bins: int = 10, points: int = 100) -> DataFrame:
    """``feature, psi, severity, ks, ks_p_value`` with means and sizes, as :func:`drift.compare` but from window profiles.

    Each side's distribution is read off at ``STEPS`` equal steps, which adds half a step to a share's error; the largest gap is
    sought just below and at ``points`` quantiles of either side.
    """
    both = reference.select("feature", *[F.col(c).alias(f"r_{c}") for c in ("sketch", "n", "total")]).join(current.select("feature", *[F.col(c).alias(f"c_{c}") for c in ("sketch", "n", "total")]), "feature")
    steps = [(i + 0.5) / STEPS for i in range(STEPS)]
    read = both.select("*", _quantiles("r_sketch", steps).alias("r"), _quantiles("c_sketch", steps).alias("c"), F.array_distinct(_quantiles("r_sketch", [i / bins for i in range(bins + 1)])).alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    every = STEPS // points
    grid = F.array_distinct(F.concat(*[F.filter(side, lambda _, i: i % every == 0) for side in "rc"]))
    read = read.withColumns({"inner": inner, "grid": grid})
    zero, one = F.array(F.lit(0.0)), F.array(F.lit(1.0))
    parts = lambda side: F.zip_with(F.concat(_shares(side, F.col("inner")), one), F.concat(zero, _shares(side, F.col("inner"))), lambda hi, lo: F.greatest(hi - lo, F.lit(FLOOR)))
    moved = F.zip_with(parts("r"), parts("c"), lambda p, q: (q - p) * F.log(q / p))
    psi = F.when(F.size("edges") > 1, F.aggregate(moved, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    gap = lambda inclusive: F.array_max(F.zip_with(_shares("r", F.col("grid"), inclusive), _shares("c", F.col("grid"), inclusive), lambda a, b: F.abs(a - b)))
    found = read.withColumns({"psi": psi, "ks": F.greatest(gap(False), gap(True))})
    return found.select(
        "feature", "psi", severity(F.col("psi")).alias("severity"), "ks", ks_p_value(F.col("ks"), F.col("r_n").cast("double"), F.col("c_n").cast("double")).alias("ks_p_value"),
        (F.col("r_total") / F.col("r_n")).alias("reference_mean"), F.col("r_n").alias("reference_n"), (F.col("c_total") / F.col("c_n")).alias("current_mean"), F.col("c_n").alias("current_n"),
    )


def watched_profiles(users: DataFrame, products: DataFrame, k: int = K) -> DataFrame:
    """Profiles of the 13 watched features from ``users (user_id, day, features)`` and ``products (product_id, day, features)``."""
    return daily_profiles(users, USER_WATCH, k=k).unionByName(daily_profiles(products, PRODUCT_WATCH, k=k))


def daily_audience(events: DataFrame, slices: list[str], user: str = "user_id", at: str = "occurred_at", lg: int = LG) -> DataFrame:
    """``day, slices, users (sketch), n`` of events with a user."""
    day = F.floor(F.unix_micros(at) / 86_400_000_000).cast("int")
    return events.filter(F.col(user).isNotNull()).groupBy(day.alias("day"), *slices).agg(F.theta_sketch_agg(user, lg).alias("users"), F.count(F.lit(1)).alias("n"))


def audience(daily: DataFrame, first: int, last: int, slices: list[str], lg: int = LG) -> DataFrame:
    """``slices, users (sketch), n`` of a window; ``slices`` may be fewer than the table has."""
    return daily.filter(F.col("day").between(first, last)).groupBy(*slices).agg(F.theta_union_agg("users", lg).alias("users"), F.sum("n").alias("n"))


def reach(window: DataFrame) -> DataFrame:
    """``window`` with the number of users in place of the sketch."""
    return window.withColumn("users", F.theta_sketch_estimate("users"))


def overlap(a: DataFrame, b: DataFrame, slices: list[str]) -> DataFrame:
    """``slices, a_users, b_users, both, either``: users of two windows, of both, of any."""
    met = a.select(*slices, F.col("users").alias("a")).join(b.select(*slices, F.col("users").alias("b")), slices, "full_outer")
    count = lambda sketch: F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))
    either = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), count(F.theta_union("a", "b"))).otherwise(count("a") + count("b"))
    return met.select(*slices, count("a").alias("a_users"), count("b").alias("b_users"), count(F.theta_intersection("a", "b")).alias("both"), either.alias("either"))


def daily_users(events: DataFrame, slices: list[str], user: str = "user_id", at: str = "occurred_at") -> DataFrame:
    """``day, slices, user_id`` of events with a user, each once: what :func:`daily_audience` sketches, for numbers that have to be exact."""
    day = F.floor(F.unix_micros(at) / 86_400_000_000).cast("int")
    return events.filter(F.col(user).isNotNull()).select(day.alias("day"), *slices, F.col(user).alias("user_id")).distinct()


def exact_overlap(daily: DataFrame, a: tuple[int, int], b: tuple[int, int], slices: list[str]) -> DataFrame:
    """As :func:`overlap`, exactly, from the users of the days ``a`` and ``b`` (first and last): one row a user and slice is counted."""
    within = lambda days: F.bool_or(F.col("day").between(*days))
    users = daily.filter(F.col("day").between(*a) | F.col("day").between(*b)).groupBy(*slices, "user_id").agg(within(a).alias("a"), within(b).alias("b"))
    count = lambda condition: F.count(F.when(condition, 1))
    return users.groupBy(*slices).agg(count(F.col("a")).alias("a_users"), count(F.col("b")).alias("b_users"), count(F.col("a") & F.col("b")).alias("both"), F.count(F.lit(1)).alias("either"))
