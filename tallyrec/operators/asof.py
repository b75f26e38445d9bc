"""Features at many cut-offs from daily partials.

Events are read once into partials: one row for each user, day, level and key (event types, viewed products,
categories, brands, sessions, prices paid) with a count and the first and last time.  Partials of different days, files or late rows merge
by adding, and are all that is read later.

Everything a feature needs is then a running sum.  A key's first day adds one to a distinct count, and a key that goes
from ``m`` to ``m + n`` events adds ``(m + n)^2 - m^2`` to the squares that a concentration is made of.  Cut-offs are
put among the days and take the sums up to them, so no cut-off is joined with the days before it.  Only the median price
meets its user's prices at each cut-off.

A cut-off is a day (days since 1970): what happened before its midnight counts.  Rows without a user or time are left out;
a user without events before a cut-off has zeros, and 0.5 for ``price_sensitivity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import TREND_WEIGHTS
from tallyrec.functions.columns import mapped, ratio, unsent
from tallyrec.operators.features import PRODUCT_FEATURES, USER_FEATURES, average_rank, derived_product_features, derived_user_features
from tallyrec.session import written

DAY = 86_400_000_000


def day_of(at: str) -> Column:
    """Days since 1970."""
    return F.floor(F.unix_micros(at) / DAY).cast("int")


def user_days(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``user_id, day, level, key, value, pct, n, first_us, last_us`` of interactions (with category, brand and price)."""
    pct = average_rank(products.select(F.col("id").alias("product_id"), "price"), "price", "pct").select("product_id", "pct")
    rows = rows.filter("user_id is not null and occurred_at is not null").join(unsent(pct), "product_id", "left")
    none = F.lit(None).cast("double")

    def part(level: str, key: Column, keep: Column, value: Column = none, pct: Column = none) -> Column:
        return F.when(keep, F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"), value.cast("double").alias("value"), pct.cast("double").alias("pct")))

    kind = F.col("event_type")
    bought = (kind == "PURCHASE") & F.col("price").isNotNull()
    parts = [
        part("event", F.coalesce(kind, F.lit("")), F.lit(True)),
        part("viewed", F.col("product_id"), (kind == "PRODUCT_VIEW") & F.col("product_id").isNotNull()),
        *[part(level, F.col(c), F.col(c).isNotNull()) for level, c in (("category", "category_id"), ("brand", "brand_id"), ("session", "session_key"))],
        part("price", F.col("price"), bought, F.col("price"), F.col("pct")),
    ]
    opened = rows.select("user_id", day_of("occurred_at").alias("day"), F.unix_micros("occurred_at").alias("us"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return opened.groupBy("user_id", "day", "p.level", "p.key", "p.value", "p.pct").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def merge_days(*partials: DataFrame) -> DataFrame:
    """Partials added up."""
    whole = partials[0]
    for more in partials[1:]:
        whole = whole.unionByName(more)
    sums = {"n": F.sum, "first_us": F.min, "last_us": F.max, "worth": F.sum}
    keys = [c for c in whole.columns if c not in sums]
    return whole.groupBy(*keys).agg(*[f(c).alias(c) for c, f in sums.items() if c in whole.columns])


#: Running sums of a user, and how a day's partial rows add to them.
def _user_sums() -> dict[str, Column]:
    level, key, n, fresh, squares = (F.col(c) for c in ("level", "key", "n", "fresh", "squares"))
    events = lambda *kinds: F.when((level == "event") & key.isin(*kinds), n)
    return {
        "total_events": F.when(level == "event", n),
        "total_views": events("PRODUCT_VIEW"),
        "total_clicks": events("PRODUCT_CLICK"),
        "total_carts": events("ADD_TO_CART"),
        "total_purchases": events("PURCHASE"),
        **{name: F.when(level == of, fresh) for name, of in (("distinct_products_viewed", "viewed"), ("distinct_categories", "category"), ("distinct_brands", "brand"), ("session_count", "session"))},
        "total_spending": F.when(level == "price", F.col("value") * n),
        "paid": F.when(level == "price", n),
        "pct_sum": F.when(level == "price", F.col("pct") * n),
        **{f"{of}_{what}": F.when(level == of, c) for of in ("category", "brand") for what, c in (("n", n), ("squares", squares))},
    }


def user_features_at(partials: DataFrame, cuts: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """The 27 user features of each of ``cuts (user_id, day)``."""
    cuts = written(cuts.select("user_id", F.col("day").cast("int").alias("day")).filter("user_id is not null and day is not null").distinct(), "cuts")
    partials = written(partials, "user-days")
    before = W.partitionBy("user_id", "level", "key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    m = F.coalesce(F.sum("n").over(before), F.lit(0))
    counted = partials.filter("level <> 'price' or value is not null").select("*", (m == 0).cast("int").alias("fresh"), (F.pow(m + F.col("n"), 2) - F.pow(m, 2)).alias("squares"))
    sums = _user_sums()
    of_event, of_purchase = F.col("level") == "event", (F.col("level") == "event") & (F.col("key") == "PURCHASE")
    daily = counted.groupBy("user_id", "day").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()],
        F.max(of_event.cast("int")).alias("active_days"),
        F.min(F.when(of_event, F.col("first_us"))).alias("first_us"),
        F.max(F.when(of_event, F.col("last_us"))).alias("last_us"),
        F.min(F.when(of_purchase, F.col("first_us"))).alias("bought_first"),
        F.max(F.when(of_purchase, F.col("last_us"))).alias("bought_last"),
    )
    if orders is not None:
        paid = orders.filter("user_id is not null").groupBy("user_id", day_of("placed_at").alias("day")).agg(F.sum("grand_total").alias("order_sum"), F.count("grand_total").alias("orders"))
        daily = daily.unionByName(paid, allowMissingColumns=True)
    else:
        daily = daily.withColumns({"order_sum": F.lit(None).cast("double"), "orders": F.lit(None).cast("long")})
    merged = daily.withColumn("cut", F.lit(1)).unionByName(cuts.withColumn("cut", F.lit(0)), allowMissingColumns=True)
    # a cut-off stands before its own day
    upto = W.partitionBy("user_id").orderBy("day", "cut").rowsBetween(W.unboundedPreceding, 0)
    lowest, highest = ("first_us", "bought_first"), ("last_us", "bought_last")
    added = [*sums, "active_days", "order_sum", "orders"]
    run = merged.select("user_id", "day", "cut", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in added], *[F.min(c).over(upto).alias(c) for c in lowest], *[F.max(c).over(upto).alias(c) for c in highest]).filter("cut = 0").drop("cut")
    prices = partials.filter("level = 'price' and value is not null").select("user_id", F.col("day").alias("paid_on"), "value", "n")
    medians = cuts.join(prices, "user_id").filter(F.col("paid_on") < F.col("day")).groupBy("user_id", "day").agg(F.percentile("value", 0.5, F.col("n")).alias("median_purchase_price"))
    us = F.col("day").cast("long") * DAY
    base = run.join(medians, ["user_id", "day"], "left").withColumns(
        {
            "avg_purchase_price": F.try_divide("total_spending", "paid"),
            "price_percentile_mean": F.try_divide("pct_sum", "paid"),
            "days_since_last_event": (us - F.col("last_us")) / DAY,
            "days_since_first_seen": (us - F.col("first_us")) / DAY,
            "_since_purchase": (us - F.col("bought_last")) / DAY,
            "_purchase_span": (F.col("bought_last") - F.col("bought_first")) / DAY,
            "avg_order_value": F.when(F.col("total_events") > 0, F.try_divide("order_sum", "orders")),
            **{f"{of}_concentration": F.try_divide(f"{of}_squares", F.pow(f"{of}_n", 2)) for of in ("category", "brand")},
        }
    )
    return derived_user_features(base).select("user_id", "day", *USER_FEATURES).fillna(0, list(USER_FEATURES))


def product_days(rows: DataFrame, half: float = 42.0) -> DataFrame:
    """``product_id, user_id, day, event_type, n, worth``; ``worth`` is the event weights decayed to the end of the day."""
    rows = rows.filter("product_id is not null and occurred_at is not null").withColumn("day", day_of("occurred_at"))
    hours = ((F.col("day").cast("long") + 1) * DAY - F.unix_micros("occurred_at")) / 3.6e9
    worth = mapped(F.col("event_type"), TREND_WEIGHTS, 0.0) * F.pow(F.lit(0.5), hours / half)
    buyer = F.when(F.col("event_type") == "PURCHASE", F.col("user_id"))
    return rows.groupBy("product_id", buyer.alias("user_id"), "day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(worth).alias("worth"))


def product_features_at(partials: DataFrame, products: DataFrame, days: list[int], *, prior: float = 20.0, half: float = 42.0, trend_days: int = 7) -> DataFrame:
    """The 25 product features of the whole catalogue at each of ``days``."""
    # partials and what comes of them are read several times
    partials = written(partials, "product-days")
    kind = F.col("event_type")
    buys = partials.filter((kind == "PURCHASE") & F.col("user_id").isNotNull())
    before = W.partitionBy("product_id", "user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    m = F.coalesce(F.sum("n").over(before), F.lit(0))
    buyers = buys.select("product_id", "day", (m == 0).cast("int").alias("buyers"), ((m < 2) & (m + F.col("n") > 1)).cast("int").alias("repeaters")).groupBy("product_id", "day").agg(F.sum("buyers").alias("buyers"), F.sum("repeaters").alias("repeaters"))
    of = lambda t: F.sum(F.when(kind == t, F.col("n")))
    daily = partials.groupBy("product_id", "day").agg(of("PRODUCT_VIEW").alias("views"), of("ADD_TO_CART").alias("carts"), of("PURCHASE").alias("bought"), F.sum("worth").alias("worth"))
    daily = daily.join(buyers, ["product_id", "day"], "left")
    catalogue = average_rank(products, "price", "price_percentile", ["category_id"]).withColumnRenamed("id", "product_id").withColumn("day", F.explode(F.array(*[F.lit(int(d)) for d in sorted(set(days))])))
    keys = catalogue.select("product_id", "day").withColumn("cut", F.lit(True))
    merged = daily.withColumn("cut", F.lit(False)).unionByName(keys, allowMissingColumns=True)
    back = lambda n: W.partitionBy("product_id").orderBy("day").rangeBetween(W.unboundedPreceding if n is None else -n, -1)
    summed = {"view_count_total": ("views", None), "view_count_30d": ("views", 30), "view_count_7d": ("views", 7), "cart_count_30d": ("carts", 30), "purchase_count_total": ("bought", None), "purchase_count_30d": ("bought", 30), "distinct_buyers": ("buyers", None), "repeaters": ("repeaters", None)}
    run = merged.select("product_id", "day", "cut", *[F.sum(c).over(back(n)).alias(name) for name, (c, n) in summed.items()]).filter("cut").drop("cut")
    # each day's worth goes to the cut-offs of the days after it
    ahead = daily.select("product_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(trend_days)), lambda k: F.col("day") + k)).alias("k", "day"), "worth")
    trends = ahead.groupBy("product_id", "day").agg(F.sum(F.col("worth") * F.pow(F.lit(0.5), F.col("k") * 24 / half)).alias("trending_score"))
    released = (F.col("day").cast("long") * DAY - F.unix_micros(F.col("released_at").cast("timestamp"))) / DAY
    base = catalogue.select("product_id", "day", "price", F.log1p("price").alias("log_price"), "price_percentile", "category_id", "brand_id", "rating_average", "rating_count", "stock_quantity", F.greatest(released, F.lit(0.0)).alias("days_since_release"))
    base = base.join(run, ["product_id", "day"], "left").join(trends, ["product_id", "day"], "left").fillna(0)
    base = written(base, "product-counts")
    base = derived_product_features(base.withColumn("repeat_purchase_rate", ratio(F.col("repeaters"), F.col("distinct_buyers"))), prior, ["day"])
    scores = ("popularity_score", "trending_score", "novelty_score")
    bounds = base.groupBy("day").agg(*[f(c).alias(f"{c}_{end}") for c in scores for f, end in ((F.min, "lo"), (F.max, "hi"))])
    low, high = (lambda c: F.col(f"{c}_lo")), (lambda c: F.col(f"{c}_hi"))
    scaled = {c: F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).otherwise(0.0) for c in scores}
    return base.join(bounds, "day").withColumns(scaled).select("product_id", "day", *PRODUCT_FEATURES)
