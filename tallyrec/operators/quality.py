"""Data-quality gates and dataset diagnostics.

Checks are rows ``check, measured, threshold, comparison, passed, inconclusive, detail``;
a check is inconclusive only for want of data, and then counts as passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import count_if, ratio
from tallyrec.operators.evaluation import gini


def check(df: DataFrame, name: str, measured: Column, threshold: float | Column, comparison: str = ">=", sample: Column | None = None, least: int = 0, detail: Column | None = None) -> DataFrame:
    """One check row for each row of ``df`` (usually one)."""
    threshold = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    value = measured.cast("double")
    holds = {">=": value >= threshold, "<=": value <= threshold, ">": value > threshold, "<": value < threshold, "==": value == threshold}[comparison]
    short = F.coalesce(sample < least, F.lit(True)) if sample is not None else F.lit(False)
    return df.select(
        F.lit(name).alias("check"),
        value.alias("measured"),
        threshold.alias("threshold"),
        F.lit(comparison).alias("comparison"),
        (short | F.coalesce(holds, F.lit(False))).alias("passed"),
        F.when(short, F.lit("too few rows")).alias("inconclusive"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )


def training_contract(rows: DataFrame, products: DataFrame, least: int = 1000) -> DataFrame:
    """Enough interactions, no null ids, no product outside the catalogue."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("user_id").isNull() | F.col("product_id").isNull()).alias("nulls"))
    lost = orphans(rows, products, "product_id", "id")
    return check(facts, "enough_interactions", F.col("n"), least).unionByName(check(facts, "no_null_ids", F.coalesce("nulls", F.lit(0)), 0, "==")).unionByName(check(lost, "no_orphan_products", F.col("n"), 0, "=="))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """How many rows have a key that no parent has."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def row_counts(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    rows = None
    for name, limit in least.items():
        one = check(tables[name].agg(F.count(F.lit(1)).alias("n")), f"rows_{name}", F.col("n"), limit)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def rows_by_month(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("occurred_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def event_mix(events: DataFrame) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).cast("double").alias("total"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def views(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'PRODUCT_VIEW' and product_id is not null")


def top_percent_share(events: DataFrame) -> DataFrame:
    """The share of views that the first of 100 tiles of products has."""
    counts = views(events).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    # products of equal counts are counted first, so the ordered window is over distinct counts
    bins = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    tile = F.ceil(F.sum("m").over(W.partitionBy()) / 100.0)
    taken = F.greatest(F.least(tile - F.coalesce(F.sum("m").over(w), F.lit(0)), F.col("m")), F.lit(0))
    return bins.withColumn("taken", taken).agg(F.round(F.sum(F.col("taken") * F.col("n")) / F.sum(F.col("m") * F.col("n")), 6).alias("share"))


def top_share_median(rows: DataFrame, level: str, least: int = 5) -> DataFrame:
    """Median over users (with ``least`` views or more) of the share of their main ``level``."""
    counts = views(rows).filter(F.col(level).isNotNull()).groupBy("user_id", level).agg(F.count(F.lit(1)).alias("n"))
    users = counts.groupBy("user_id").agg(F.max("n").alias("top"), F.sum("n").alias("total")).filter(F.col("total") >= least)
    return users.agg(F.round(F.percentile(F.col("top") / F.col("total"), 0.5), 6).alias("median_share"), F.count(F.lit(1)).alias("users"))


def span_days(events: DataFrame) -> DataFrame:
    return events.agg(F.datediff(F.max("occurred_at"), F.min("occurred_at")).alias("days"))


def recent_of_user(events: DataFrame, user_id: int, k: int = 50) -> DataFrame:
    return events.filter(F.col("user_id") == user_id).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(k).select("event_id", "event_type", "product_id")


def available(products: DataFrame, category: str, k: int = 50) -> DataFrame:
    good = products.filter((F.col("category_id") == category) & F.col("is_active") & (F.col("stock_quantity") > 0))
    return good.orderBy("price", "id").limit(k).select("id", "price")


def bought_with(items: DataFrame, product_id: int, k: int = 10) -> DataFrame:
    """What is most often in the same orders as one product."""
    orders = items.filter(F.col("product_id") == product_id).select("order_id").distinct()
    rest = items.filter(F.col("product_id") != product_id).select("order_id", "product_id").distinct().join(orders, "order_id", "left_semi")
    return rest.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_id").limit(k)


def affinity_lift(rows: DataFrame, preferred: DataFrame, level: str = "category_id") -> DataFrame:
    """Purchases per view inside and outside each user's preferred ``level`` (``user_id, preferred``)."""
    met = rows.join(preferred, "user_id").withColumn("inside", F.col(level) == F.col("preferred"))
    n = lambda kind, side: count_if((F.col("event_type") == kind) & (F.col("inside") == side))
    rates = met.agg(ratio(n("PURCHASE", True), n("PRODUCT_VIEW", True)).alias("inside"), ratio(n("PURCHASE", False), n("PRODUCT_VIEW", False)).alias("outside"))
    return rates.select(F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"), F.round(ratio(F.col("inside"), F.col("outside")), 6).alias("lift"))


def brand_over_index(rows: DataFrame, liked: DataFrame, products: DataFrame) -> DataFrame:
    """How much oftener purchases are of a liked brand (``user_id, brands`` array) than the catalogue would have it."""
    bought = rows.filter("event_type = 'PURCHASE'").join(liked, "user_id")
    share = bought.agg(F.avg(F.array_contains("brands", F.col("brand_id")).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
    catalogue = products.groupBy("brand_id").agg(F.count(F.lit(1)).alias("m"))
    total = products.agg(F.count(F.lit(1)).cast("double").alias("total"))
    expected = liked.select("user_id", F.explode("brands").alias("brand_id")).join(catalogue, "brand_id").crossJoin(F.broadcast(total)).groupBy("user_id").agg((F.sum("m") / F.first("total")).alias("e")).agg(F.avg("e").alias("expected"))
    return share.crossJoin(expected).select(F.round("share", 6).alias("share"), F.round("expected", 6).alias("expected"), F.round(ratio(F.col("share"), F.col("expected")), 6).alias("index"), "n")


def correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation with the lower end of its 95 % interval (Fisher)."""
    facts = pairs.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    inner = F.when((F.col("n") > 3) & (F.abs("r") < 1), F.tanh(F.atanh("r") - 1.959963985 / F.sqrt(F.col("n") - 3.0)))
    return facts.select(F.round("r", 6).alias("r"), F.round(inner, 6).alias("low"), "n")


def pair_lift(items: DataFrame, declared: DataFrame, least: int = 20) -> DataFrame:
    """Lift ``P(b | a) / P(b)`` of declared pairs ``(a, b)`` of groups; ``items`` are ``(order_id, group)``."""
    sets = items.select("order_id", "group").distinct()
    total = sets.agg(F.countDistinct("order_id").cast("double").alias("total"))
    counts = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.alias("x"), sets.alias("y")
    wanted = declared.join(a.select(F.col("group").alias("a"), F.col("order_id")), "a").join(b.select(F.col("group").alias("b"), F.col("order_id")), ["order_id", "b"])
    both = wanted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    rows = declared.join(both, ["a", "b"], "left").join(counts.select(F.col("group").alias("a"), F.col("n").alias("n_a")), "a", "left").join(counts.select(F.col("group").alias("b"), F.col("n").alias("n_b")), "b", "left").crossJoin(F.broadcast(total))
    lift = F.when((F.col("n_a") >= least) & (F.col("n_b") >= least), F.round(F.coalesce("n_ab", F.lit(0)) * F.col("total") / (F.col("n_a") * F.col("n_b")), 6))
    return rows.select("a", "b", F.coalesce("n_ab", F.lit(0)).alias("n_ab"), lift.alias("lift"))


def consecutive_relatedness(rows: DataFrame, level: str = "category_id") -> DataFrame:
    """How much oftener two views in a row share ``level`` than independent ones would."""
    seen = views(rows)
    w = W.partitionBy("session_key").orderBy("occurred_at", "product_id")
    steps = seen.withColumn("before", F.lag(level).over(w)).filter("before is not null")
    same = steps.agg(F.avg((F.col("before") == F.col(level)).cast("double")).alias("same"), F.count(F.lit(1)).alias("n"))
    counts = seen.groupBy(level).agg(F.count(F.lit(1)).cast("double").alias("m"))
    chance = counts.agg((F.sum(F.col("m") * F.col("m")) / F.pow(F.sum("m"), 2)).alias("chance"))
    return same.crossJoin(chance).select(F.round("same", 6).alias("same"), F.round("chance", 6).alias("chance"), F.round(ratio(F.col("same"), F.col("chance")), 6).alias("lift"), "n")


def segment_spend(orders: DataFrame, users: DataFrame) -> DataFrame:
    spend = orders.groupBy("user_id").agg(F.sum("grand_total").alias("spend"))
    return users.join(spend, F.col("id") == F.col("user_id"), "left").groupBy("segment").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg(F.coalesce("spend", F.lit(0.0))), 4).alias("mean_spend"))


def popularity_skew(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Gini index of views over the whole catalogue, products without views included."""
    counts = products.select(F.col("id").alias("product_id")).join(views(rows).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), "product_id", "left").fillna(0, ["n"])
    return gini(counts, []).select(F.round("gini", 6).alias("gini"))


def density(rows: DataFrame, users: int | None = None, products: int | None = None) -> DataFrame:
    """Distinct pairs over users times products, with the threshold it must stay under."""
    pairs = rows.groupBy("user_id", "product_id").agg(F.lit(1).alias("one"))
    facts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("products"))
    u, p = (F.lit(users) if users else F.col("users")), (F.lit(products) if products else F.col("products"))
    return facts.select("pairs", F.round(F.col("pairs") / (u * p), 6).alias("density"), F.round(F.greatest(F.lit(0.01), 20.0 / p), 6).alias("threshold"))


def repeat_share(rows: DataFrame) -> DataFrame:
    pairs = rows.filter("event_type = 'PURCHASE'").groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("repeat_share"), F.count(F.lit(1)).alias("pairs"))


def cold_start(rows: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Users with no and with at most three interactions, and products never touched."""
    n = users.select(F.col("id").alias("user_id")).join(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").fillna(0, ["n"])
    people = n.agg(count_if(F.col("n") == 0).alias("cold_users"), count_if(F.col("n") <= 3).alias("sparse_users"))
    items = products.select(F.col("id").alias("product_id")).join(rows.select("product_id"), "product_id", "left_anti").agg(F.count(F.lit(1)).alias("untouched_products"))
    return people.crossJoin(items)


def temporal_coverage(events: DataFrame) -> DataFrame:
    """Share of days with events, and the variation of their daily number."""
    days = events.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    filled = span.join(days, "day", "left").fillna(0, ["n"])
    return filled.agg(F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("active_share"), F.round(F.stddev_samp("n") / F.avg("n"), 6).alias("variation"), F.count(F.lit(1)).alias("days"))


def funnel_ratios(rows: DataFrame) -> DataFrame:
    n = lambda t: count_if(F.col("event_type") == t)
    sessions = rows.groupBy("session_key").agg(F.max((F.col("event_type") == "PURCHASE").cast("double")).alias("bought")).agg(F.avg("bought").alias("session_conversion"))
    whole = rows.agg(F.round(ratio(n("PURCHASE"), n("PRODUCT_VIEW")), 6).alias("view_to_purchase"), F.round(ratio(n("ADD_TO_CART"), n("PRODUCT_VIEW")), 6).alias("view_to_cart"))
    return whole.crossJoin(sessions.select(F.round("session_conversion", 6).alias("session_conversion")))


def items_per_order(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("items_per_order"), F.count(F.lit(1)).alias("orders"))


def unreconciled(orders: DataFrame, items: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Orders whose lines don't add up to their subtotal."""
    sums = items.groupBy("order_id").agg(F.sum("line_total").alias("lines"))
    return orders.join(sums, orders["id"] == sums["order_id"]).filter(F.abs(F.col("lines") - F.col("subtotal")) > tolerance).select("id", "subtotal", "lines")


def early_views(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Views before the product's release, and events outside the window of a session of that name."""
    met = views(rows).join(products.select(F.col("id").alias("product_id"), "released_at"), "product_id")
    return met.agg(count_if(F.to_date("occurred_at") < F.col("released_at")).alias("early"), F.count(F.lit(1)).alias("views"))


def session_mismatches(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose stored count or window differs from their events."""
    counts = events.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    met = sessions.join(counts, "session_key", "full_outer")
    return met.filter(~(F.col("event_count").eqNullSafe(F.col("n")) & (F.col("started_at") <= F.col("lo")) & (F.col("ended_at") >= F.col("hi"))) | F.col("n").isNull() | F.col("event_count").isNull()).select("session_key", "event_count", "n")


def gate(checks: list[DataFrame]) -> DataFrame:
    """How many checks passed, failed or were inconclusive, and whether all may go on."""
    rows = checks[0]
    for one in checks[1:]:
        rows = rows.unionByName(one)
    unsure = F.col("inconclusive").isNotNull()
    return rows.agg(count_if(F.col("passed") & ~unsure).alias("passed"), count_if(~F.col("passed")).alias("failed"), count_if(unsure).alias("inconclusive"), F.bool_and("passed").alias("all_passed"))
