"""Analytics of the serving log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import ratio
from tallyrec.operators.significance import sample_ratio, two_proportions

HEALTHY = ("ranker", "hybrid")


def outcomes(served: DataFrame, clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row a recommendation: each outcome is summed first, so joins don't multiply revenue."""
    c = clicks.groupBy("recommendation_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    v = conversions.groupBy("recommendation_id").agg(F.count(F.lit(1)).alias("n_conversions"), F.sum("revenue").alias("revenue"))
    return served.join(c, "recommendation_id", "left").join(v, "recommendation_id", "left").fillna(0, ["n_clicks", "n_conversions", "revenue"])


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "ctr": F.round(ratio(F.col("clicks"), F.col("impressions")), 6),
            "cvr": F.round(ratio(F.col("conversions"), F.col("clicks")), 6),
            "revenue_per_user": F.round(ratio(F.col("revenue"), F.col("users")), 6),
            "aov": F.round(ratio(F.col("revenue"), F.col("conversions")), 6),
        }
    )


_SUMS = (F.count, F.sum)


def _counts():
    return [F.count(F.lit(1)).alias("impressions"), F.sum("n_clicks").alias("clicks"), F.sum("n_conversions").alias("conversions"), F.round(F.sum("revenue"), 6).alias("revenue"), F.countDistinct("user_id").alias("users")]


def funnel(rows: DataFrame, by: str) -> DataFrame:
    return with_rates(rows.groupBy(by).agg(*_counts()))


def overview(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Totals and each slice in one pass; distinct users are counted anew in each."""
    sets = rows.groupingSets([[], *[[s] for s in slices]], *slices).agg(F.grouping_id().alias("_g"), *_counts())
    name, value = F.lit("total"), F.lit("all")
    for i, s in enumerate(slices):
        mine = F.col("_g") == (2 ** len(slices) - 1) - 2 ** (len(slices) - 1 - i)
        name, value = F.when(mine, s).otherwise(name), F.when(mine, F.coalesce(F.col(s).cast("string"), F.lit("none"))).otherwise(value)
    return with_rates(sets.withColumn("slice", name).withColumn("value", value).drop("_g", *slices))


def fallback_rate(served: DataFrame) -> DataFrame:
    return served.agg(F.count(F.lit(1)).alias("served"), F.coalesce(F.avg((~F.coalesce(F.col("strategy").isin(*HEALTHY), F.lit(False))).cast("double")), F.lit(0.0)).alias("fallback_rate"))


def top_products(rows: DataFrame, k: int = 20) -> DataFrame:
    counts = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("served"), F.sum("n_clicks").alias("clicks"), F.sum("n_conversions").alias("conversions"), F.round(F.sum("revenue"), 6).alias("revenue"))
    return counts.withColumn("ctr", F.round(ratio(F.col("clicks"), F.col("served")), 6)).orderBy(F.desc("served"), "product_id").limit(k)


def experiment_readout(rows: DataFrame, control: str = "control", least_users: int = 1000) -> DataFrame:
    """Each treatment against the control on clicks and conversions; ``ready`` if both have enough users.

    ``rows`` are outcomes of one experiment, with their ``variant``.
    """
    arms = rows.groupBy("variant").agg(*_counts())
    base = arms.filter(F.col("variant") == control).select(F.col("impressions").alias("i1"), F.col("clicks").alias("c1"), F.col("conversions").alias("v1"), F.col("users").alias("u1"))
    met = arms.filter(F.col("variant") != control).crossJoin(F.broadcast(base))
    out = None
    for metric, (x1, n1, x2, n2) in {"ctr": ("c1", "i1", "clicks", "impressions"), "cvr": ("v1", "c1", "conversions", "clicks")}.items():
        one = two_proportions(met, x1, n1, x2, n2).select("variant", F.lit(metric).alias("metric"), "rate_1", "rate_2", "difference", "z", "low", "high", "p_value", "significant", (F.least("users", "u1") >= least_users).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


def readout_mismatch(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Whether the arms' users are split as planned."""
    arms = rows.groupBy("variant").agg(F.countDistinct("user_id").alias("n"))
    plan = rows.sparkSession.createDataFrame(list(shares.items()), "variant string, expected_share double")
    return sample_ratio(plan.join(arms, "variant", "left").fillna(0, ["n"]))


def attribute(purchases: DataFrame, clicks: DataFrame, hours: int = 168, policy: str = "last_click") -> DataFrame:
    """The latest click on the same product by the same user within ``hours`` before each purchase.

    Clicks and purchases are merged into one ordered stream for each (user, product) and the last
    click is carried forward, so no pairs are formed.
    """
    c = clicks.select("user_id", "product_id", "occurred_at", F.lit(None).cast("long").alias("purchase_id"), F.col("event_id").alias("click_id"), F.lit(0).alias("kind"))
    p = purchases.select("user_id", "product_id", "occurred_at", F.col("event_id").alias("purchase_id"), F.lit(None).cast("long").alias("click_id"), F.lit(1).alias("kind"))
    w = W.partitionBy("user_id", "product_id").orderBy("occurred_at", "kind", "click_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("click_id", F.col("occurred_at").alias("at"))), ignorenulls=True).over(w)
    merged = c.unionByName(p).withColumn("click", last).filter("kind = 1")
    inside = F.unix_micros("occurred_at") - F.unix_micros("click.at") <= hours * 3_600_000_000
    return merged.select("purchase_id", "user_id", "product_id", F.when(inside, F.col("click.click_id")).alias("click_id"), F.lit(policy).alias("policy"), F.lit(hours).alias("window_hours"))


def impression_clicks(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each impression with its first click and the delay."""
    first = clicks.groupBy("recommendation_id").agg(F.min("occurred_at").alias("clicked_at"), F.count(F.lit(1)).alias("n_clicks"))
    return impressions.join(first, "recommendation_id", "left").withColumn("delay_ms", (F.unix_micros("clicked_at") - F.unix_micros("occurred_at")) / 1000)


def position_curve(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("position").agg(F.count(F.lit(1)).alias("impressions"), F.sum((F.col("n_clicks") > 0).cast("int")).alias("clicked"))
    return counts.withColumn("ctr", F.round(ratio(F.col("clicked"), F.col("impressions")), 6))


#: rule -> (column of the window's facts, comparison, threshold).  Fixed values.
HEALTH_RULES = {"fallback_rate": ("fallback_rate", ">", 0.25), "slow": ("p95_ms", ">", 80.0), "empty": ("empty_rate", ">", 0.05), "cold_cache": ("cache_hit_rate", "<", 0.60)}


def health(log: DataFrame) -> DataFrame:
    """Rules that a surface breaks in a five-minute window of the request log ``(at, surface, strategy, latency_ms, n_items, cached)``."""
    fell = ~F.coalesce(F.col("strategy").isin(*HEALTHY), F.lit(False))
    facts = log.groupBy(F.window("at", "5 minutes").alias("w"), "surface").agg(F.avg(fell.cast("double")).alias("fallback_rate"), F.percentile("latency_ms", 0.95).alias("p95_ms"), F.avg((F.col("n_items") == 0).cast("double")).alias("empty_rate"), F.avg(F.col("cached").cast("double")).alias("cache_hit_rate"))
    broken = [F.when(F.col(c) > t if sign == ">" else F.col(c) < t, F.struct(F.lit(name).alias("rule"), F.col(c).alias("measured"), F.lit(t).alias("threshold"))) for name, (c, sign, t) in HEALTH_RULES.items()]
    opened = facts.select(F.unix_micros("w.start").alias("window_us"), "surface", F.explode(F.array_compact(F.array(*broken))).alias("b"))
    return opened.select("window_us", "surface", "b.*")
