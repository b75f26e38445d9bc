"""Implicit-feedback weights from conversion odds."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import PRIOR_WEIGHTS
from tallyrec.functions.columns import age, count_if, half_life, mapped, steady_sum


def first_purchases(rows: DataFrame) -> DataFrame:
    return rows.filter("event_type = 'PURCHASE'").groupBy("user_id", "product_id").agg(F.min("occurred_at").alias("purchased_at"))


def conversions(rows: DataFrame, window_days: int = 30) -> DataFrame:
    """Each event with ``converted``: its pair's first purchase is within the window, before or after."""
    gap = F.abs(F.unix_micros("purchased_at") - F.unix_micros("occurred_at"))
    joined = rows.join(first_purchases(rows), ["user_id", "product_id"], "left")
    return joined.withColumn("converted", F.coalesce(gap <= window_days * 86_400_000_000, F.lit(False)))


def conversion_rates(rows: DataFrame, window_days: int = 30) -> DataFrame:
    return conversions(rows, window_days).groupBy("event_type").agg(F.count(F.lit(1)).alias("support"), F.avg(F.col("converted").cast("double")).alias("rate"))


def base_rate(rows: DataFrame) -> DataFrame:
    """Purchased pairs over touched pairs, one row."""
    pairs = rows.groupBy("user_id", "product_id").agg(F.max((F.col("event_type") == "PURCHASE").cast("double")).alias("bought"))
    return pairs.agg(F.coalesce(F.avg("bought"), F.lit(0.0)).alias("base_rate"))


def derive(rates: dict[str, tuple[int, float]], base: float, min_support: int = 200) -> dict[str, dict]:
    """Weights of at most a dozen event types from ``type -> (support, rate)``."""
    if not rates or base <= 0 or "PURCHASE" not in rates:
        return {t: {"support": 0, "rate": 0.0, "lift": 0.0, "weight": w} for t, w in PRIOR_WEIGHTS.items()}
    raw = {}
    for kind, (support, rate) in rates.items():
        if kind not in ("PURCHASE", "REMOVE_FROM_CART"):
            raw[kind] = log(1 + rate / base) if support >= min_support else PRIOR_WEIGHTS.get(kind, 1.0)
    raw["PURCHASE"] = 1.6 * max([w for w in raw.values() if w > 0], default=PRIOR_WEIGHTS["PURCHASE"] / 1.6)
    if "REMOVE_FROM_CART" in rates:
        support, rate = rates["REMOVE_FROM_CART"]
        own = log(1 + rate / base) if support >= min_support else PRIOR_WEIGHTS["REMOVE_FROM_CART"]
        raw["REMOVE_FROM_CART"] = -abs(own) if own else -0.6
    unit = raw.get("PRODUCT_VIEW", 0.0)
    if unit <= 0:
        unit = min([w for w in raw.values() if w > 0], default=1.0)
    return {t: {"support": rates[t][0], "rate": rates[t][1], "lift": rates[t][1] / base, "weight": w / unit} for t, w in raw.items()}


def calibrate(rows: DataFrame, *, window_days: int = 30, min_support: int = 200) -> dict[str, dict]:
    """Support, rate, lift and weight of each event type.  A row a type comes to the driver."""
    pair = W.partitionBy("user_id", "product_id")
    bought = F.min(F.when(F.col("event_type") == "PURCHASE", F.unix_micros("occurred_at"))).over(pair)
    rows = rows.select("event_type", F.unix_micros("occurred_at").alias("us"), bought.alias("bought"), (F.row_number().over(pair.orderBy("occurred_at")) == 1).alias("first"))
    met = F.coalesce(F.abs(F.col("bought") - F.col("us")) <= window_days * 86_400_000_000, F.lit(False))
    # one exchange, by pair, for the rates of the types and the base rate of the pairs
    counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(met.cast("double")).alias("rate"), count_if(F.col("first")).alias("pairs"), count_if(F.col("first") & F.col("bought").isNotNull()).alias("bought")).collect()
    pairs = sum(r["pairs"] for r in counts)
    return derive({r["event_type"]: (r["n"], r["rate"]) for r in counts}, sum(r["bought"] for r in counts) / pairs if pairs else 0.0, min_support)


def report(spark, found: dict[str, dict]) -> DataFrame:
    rows = [(t, x["support"], x["rate"], x["lift"], x["weight"]) for t, x in found.items()]
    return spark.createDataFrame(rows, "event_type string, support long, rate double, lift double, weight double").orderBy(F.desc("weight"), "event_type")


def interaction_matrix(rows: DataFrame, weights: dict[str, float], as_of: Column, *, half_life_days: float = 45.0, most: float = 60.0) -> DataFrame:
    """Decayed weight of each (user, product): summed, then held to ``most``; those at or below zero go."""
    days = F.greatest(age(as_of, F.col("occurred_at"), 86_400), F.lit(0.0))
    worth = mapped(F.col("event_type"), weights, 1.0) * half_life(days, half_life_days)
    summed = rows.groupBy("user_id", "product_id").agg(steady_sum(worth).alias("weight"), F.min("occurred_at").alias("first_interaction_at"), F.max("occurred_at").alias("last_interaction_at"), F.count(F.lit(1)).alias("n_events"))
    return summed.withColumn("weight", F.least(F.greatest("weight", F.lit(0.0)), F.lit(most))).filter("weight > 0")


def event_type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
