"""Point-in-time features of users, products and pairs.  Every input is cut at ``as_of`` first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import TREND_WEIGHTS
from tallyrec.functions.columns import age, count_if, half_life, mapped, minmax_all, ratio, unsent

USER_FEATURES = (
    "total_events", "total_views", "total_clicks", "total_carts", "total_purchases", "distinct_products_viewed", "distinct_categories",
    "distinct_brands", "session_count", "active_days", "total_spending", "avg_purchase_price", "median_purchase_price", "avg_order_value",
    "price_percentile_mean", "price_sensitivity", "view_to_cart_rate", "cart_to_purchase_rate", "view_to_purchase_rate", "days_since_last_event",
    "days_since_first_seen", "days_since_last_purchase", "purchase_frequency_days", "events_per_active_day", "category_concentration",
    "brand_concentration", "customer_lifetime_value",
)
PRODUCT_FEATURES = (
    "price", "log_price", "price_percentile", "category_id", "brand_id", "rating_average", "rating_count", "stock_quantity", "days_since_release",
    "view_count_total", "view_count_30d", "view_count_7d", "cart_count_30d", "purchase_count_total", "purchase_count_30d", "distinct_buyers",
    "revenue_30d", "repeat_purchase_rate", "conversion_rate", "view_to_cart_rate", "quality_score", "popularity_score", "trending_score",
    "novelty_score", "is_cold",
)
PAIR_FEATURES = (
    "view_count", "cart_count", "purchase_count", "days_since_interaction", "interaction_weight", "has_interacted", "has_purchased",
    "category_affinity", "brand_affinity", "category_match", "brand_match", "price_distance", "price_band_match", "content_similarity",
    "collaborative_score",
)


def average_rank(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``out``: the average-rank percentile of ``value``, over all rows or within ``keys``.

    Equal values are counted first, so the ordered window is over distinct values.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys)
    below = F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    pct = (F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2.0) / F.sum("_n").over(w)
    return df.join(counts.select(*keys, value, pct.alias(out)), [*keys, value], "left")


def concentration(rows: DataFrame, level: str) -> DataFrame:
    """Herfindahl index of each user's events over ``level``."""
    counts = rows.filter(F.col(level).isNotNull()).groupBy("user_id", level).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy("user_id").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("concentration"))


def derived_user_features(base: DataFrame) -> DataFrame:
    """What follows from a user's counts, sums, spans and ages."""
    n = F.col("total_purchases")
    since = F.coalesce("_since_purchase", "days_since_first_seen")
    spend = F.col("total_spending")
    tenure = F.greatest("days_since_first_seen", F.lit(1.0))
    return base.withColumns(
        {
            "avg_order_value": F.coalesce("avg_order_value", "total_spending"),
            "price_sensitivity": F.when(n > 0, F.least(F.greatest(1 - F.col("price_percentile_mean"), F.lit(0.0)), F.lit(1.0))).otherwise(0.5),
            "view_to_cart_rate": ratio(F.col("total_carts"), F.col("total_views")),
            "cart_to_purchase_rate": ratio(n, F.col("total_carts")),
            "view_to_purchase_rate": ratio(n, F.col("total_views")),
            "days_since_last_purchase": since,
            "purchase_frequency_days": F.when(n > 1, F.col("_purchase_span") / (n - 1)).otherwise(F.col("days_since_first_seen")),
            "events_per_active_day": ratio(F.col("total_events"), F.col("active_days")),
            "customer_lifetime_value": spend + spend / tenure * 365 * F.exp(-since / 90),
        }
    )


def user_features(rows: DataFrame, products: DataFrame, as_of: Column, orders: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """27 columns a user.  ``rows`` are interactions (with category, brand and price)."""
    rows = rows.filter(F.col("occurred_at") < as_of)
    pct = average_rank(products.select(F.col("id").alias("product_id"), "price"), "price", "pct").select("product_id", "pct")
    rows = rows.join(unsent(pct), "product_id", "left")
    kind = lambda t: F.col("event_type") == t
    bought = lambda c: F.when(kind("PURCHASE"), F.col(c))
    first, last = F.min("occurred_at"), F.max("occurred_at")
    day = F.floor(F.unix_micros("occurred_at") / 86_400_000_000)
    base = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if(kind("PRODUCT_VIEW")).alias("total_views"),
        count_if(kind("PRODUCT_CLICK")).alias("total_clicks"),
        count_if(kind("ADD_TO_CART")).alias("total_carts"),
        count_if(kind("PURCHASE")).alias("total_purchases"),
        F.countDistinct(F.when(kind("PRODUCT_VIEW"), F.col("product_id"))).alias("distinct_products_viewed"),
        F.countDistinct("category_id").alias("distinct_categories"),
        F.countDistinct("brand_id").alias("distinct_brands"),
        F.countDistinct("session_key").alias("session_count"),
        F.countDistinct(day).alias("active_days"),
        F.coalesce(F.sum(bought("price")), F.lit(0.0)).alias("total_spending"),
        F.avg(bought("price")).alias("avg_purchase_price"),
        F.percentile(bought("price"), 0.5).alias("median_purchase_price"),
        F.avg(bought("pct")).alias("price_percentile_mean"),
        age(as_of, last, 86_400).alias("days_since_last_event"),
        age(as_of, first, 86_400).alias("days_since_first_seen"),
        age(as_of, F.max(bought("occurred_at")), 86_400).alias("_since_purchase"),
        ((F.unix_micros(F.max(bought("occurred_at"))) - F.unix_micros(F.min(bought("occurred_at")))) / 86_400e6).alias("_purchase_span"),
    )
    for level, name in (("category_id", "category_concentration"), ("brand_id", "brand_concentration")):
        base = base.join(concentration(rows, level).withColumnRenamed("concentration", name), "user_id", "left")
    if orders is not None:
        value = orders.filter(F.col("placed_at") < as_of).groupBy("user_id").agg(F.avg("grand_total").alias("avg_order_value"))
        base = base.join(value, "user_id", "left")
    else:
        base = base.withColumn("avg_order_value", F.lit(None).cast("double"))
    base = derived_user_features(base)
    out = base.select("user_id", *USER_FEATURES)
    if users is not None:
        out = users.select(F.col("id").alias("user_id")).join(out, "user_id", "left").fillna({"price_sensitivity": 0.5})
    return out.fillna(0)


def affinity(rows: DataFrame, weights: DataFrame, products: DataFrame, level: str, top_n: int) -> DataFrame:
    """Each user's ``top_n`` keys of ``level`` by summed weight, as shares of what is kept."""
    keyed = weights.join(unsent(products.select(F.col("id").alias("product_id"), level)), "product_id").filter(F.col(level).isNotNull())
    summed = keyed.groupBy("user_id", F.col(level).alias("key_id")).agg(F.sum("weight").alias("weight"))
    w = W.partitionBy("user_id").orderBy(F.desc("weight"), "key_id")
    kept = summed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    return kept.withColumn("affinity", F.col("weight") / F.sum("weight").over(W.partitionBy("user_id"))).select("user_id", "key_id", "affinity", "rank")


def trending_score(rows: DataFrame, as_of: Column, window_hours: float = 168.0, half: float = 42.0) -> DataFrame:
    """Decayed event weights of each product over the window; the age is continuous."""
    hours = age(as_of, F.col("occurred_at"), 3600)
    recent = rows.filter((F.col("occurred_at") < as_of) & (hours <= window_hours))
    return recent.groupBy("product_id").agg(F.sum(mapped(F.col("event_type"), TREND_WEIGHTS, 0.0) * half_life(age(as_of, F.col("occurred_at"), 3600), half)).alias("score"))


def derived_product_features(base: DataFrame, prior: float = 20.0, keys: list[str] | None = None) -> DataFrame:
    """What follows from a product's counts and the catalogue's totals (of each of ``keys``)."""
    keys = keys or []
    base = base.withColumn("revenue_30d", F.col("price") * F.col("purchase_count_30d"))
    totals = base.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in ("view_count_30d", "cart_count_30d", "purchase_count_30d")], F.avg(F.when(F.col("rating_count") > 0, F.col("rating_average"))).alias("_rating"))
    base = base.join(totals, keys) if keys else base.crossJoin(F.broadcast(totals))
    shrunk = lambda hits, total: (F.col(hits) + prior * ratio(F.col(f"_{hits}"), F.col(f"_{total}"))) / (F.col(total) + prior)
    return base.withColumns(
        {
            "conversion_rate": shrunk("purchase_count_30d", "view_count_30d"),
            "view_to_cart_rate": shrunk("cart_count_30d", "view_count_30d"),
            "quality_score": (F.col("rating_average") * F.col("rating_count") + F.coalesce("_rating", F.lit(0.0)) * prior) / (F.col("rating_count") + prior),
            "popularity_score": 0.55 * F.log1p("purchase_count_total") + 0.25 * F.log1p("view_count_total") + 0.20 * F.log1p("revenue_30d"),
            "novelty_score": -F.log1p(F.col("view_count_total") + F.col("purchase_count_total")),
            "is_cold": (F.col("view_count_total") + F.col("purchase_count_total") < 5).cast("int"),
        }
    )


def product_features(rows: DataFrame, products: DataFrame, as_of: Column, prior: float = 20.0) -> DataFrame:
    """25 columns a product of the catalogue."""
    rows = rows.filter(F.col("occurred_at") < as_of)
    kind = lambda t: F.col("event_type") == t
    within = lambda d: age(as_of, F.col("occurred_at"), 86_400) <= d
    counts = rows.groupBy("product_id").agg(
        count_if(kind("PRODUCT_VIEW")).alias("view_count_total"),
        count_if(kind("PRODUCT_VIEW") & within(30)).alias("view_count_30d"),
        count_if(kind("PRODUCT_VIEW") & within(7)).alias("view_count_7d"),
        count_if(kind("ADD_TO_CART") & within(30)).alias("cart_count_30d"),
        count_if(kind("PURCHASE")).alias("purchase_count_total"),
        count_if(kind("PURCHASE") & within(30)).alias("purchase_count_30d"),
    )
    buyers = rows.filter(kind("PURCHASE")).groupBy("product_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    buyers = buyers.groupBy("product_id").agg(F.count(F.lit(1)).alias("distinct_buyers"), F.avg((F.col("n") > 1).cast("double")).alias("repeat_purchase_rate"))
    base = average_rank(products, "price", "price_percentile", ["category_id"]).withColumnRenamed("id", "product_id")
    base = base.select("product_id", "price", F.log1p("price").alias("log_price"), "price_percentile", "category_id", "brand_id", "rating_average", "rating_count", "stock_quantity", F.greatest(age(as_of, F.col("released_at").cast("timestamp"), 86_400), F.lit(0.0)).alias("days_since_release"))
    base = base.join(counts, "product_id", "left").join(buyers, "product_id", "left").join(trending_score(rows, as_of).withColumnRenamed("score", "trending_score"), "product_id", "left").fillna(0)
    base = derived_product_features(base, prior)
    for name in ("popularity_score", "trending_score", "novelty_score"):
        base = minmax_all(base, name)
    return base.select("product_id", *PRODUCT_FEATURES)


def pair_history(rows: DataFrame, as_of: Column) -> DataFrame:
    rows = rows.filter(F.col("occurred_at") < as_of)
    kind = lambda t: F.col("event_type") == t
    return rows.groupBy("user_id", "product_id").agg(count_if(kind("PRODUCT_VIEW")).alias("view_count"), count_if(kind("ADD_TO_CART")).alias("cart_count"), count_if(kind("PURCHASE")).alias("purchase_count"), age(as_of, F.max("occurred_at"), 86_400).alias("days_since_interaction"))


def pair_features(candidates: DataFrame, history: DataFrame, weights: DataFrame, categories: DataFrame, brands: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """15 columns a candidate (user, product); ``content_similarity`` and ``collaborative_score`` are taken from the candidates if there."""
    own = [c for c in ("content_similarity", "collaborative_score") if c in candidates.columns]
    base = candidates.select("user_id", "product_id", *own)
    base = base.withColumns({c: F.lit(0.0) for c in ("content_similarity", "collaborative_score") if c not in own})
    base = base.join(history, ["user_id", "product_id"], "left").join(weights.select("user_id", "product_id", F.col("weight").alias("interaction_weight")), ["user_id", "product_id"], "left")
    base = base.join(unsent(products.select("product_id", "category_id", "brand_id", "price_percentile")), "product_id", "left")
    base = base.join(categories.select("user_id", F.col("key_id").alias("category_id"), F.col("affinity").alias("category_affinity")), ["user_id", "category_id"], "left")
    base = base.join(brands.select("user_id", F.col("key_id").alias("brand_id"), F.col("affinity").alias("brand_affinity")), ["user_id", "brand_id"], "left")
    base = base.join(users.select("user_id", "price_percentile_mean"), "user_id", "left")
    base = base.fillna({"days_since_interaction": 999.0, "price_percentile": 0.5, "price_percentile_mean": 0.5}).fillna(0, ["view_count", "cart_count", "purchase_count", "interaction_weight", "category_affinity", "brand_affinity", "content_similarity", "collaborative_score"])
    far = F.abs(F.col("price_percentile") - F.col("price_percentile_mean"))
    base = base.withColumns(
        {
            "has_interacted": (F.col("interaction_weight") > 0).cast("int"),
            "has_purchased": (F.col("purchase_count") > 0).cast("int"),
            "category_match": (F.col("category_affinity") > 0).cast("int"),
            "brand_match": (F.col("brand_affinity") > 0).cast("int"),
            "price_distance": far,
            "price_band_match": (far < 0.2).cast("int"),
        }
    )
    return base.select("user_id", "product_id", *PAIR_FEATURES)
