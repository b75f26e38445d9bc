"""Counters over the event log: trend buckets, recent lists, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import TREND_WEIGHTS
from tallyrec.functions.columns import mapped, top_k


def hourly_buckets(events: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """``bucket_start, scope, product_id, score``: weighted events an hour.

    ``categories (product_id, category_id)`` adds a scope for each category.  The same
    code runs on a stream, behind a watermark.
    """
    worth = mapped(F.col("event_type"), TREND_WEIGHTS, 0.0)
    rows = events.filter(F.col("product_id").isNotNull()).withColumn("worth", worth).filter("worth > 0")
    if categories is None:
        rows = rows.withColumn("scope", F.lit("all"))
    else:
        rows = rows.join(categories, "product_id", "left").withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.col("category_id")))))
    grouped = rows.groupBy(F.window("occurred_at", "1 hour"), "scope", "product_id").agg(F.sum("worth").alias("score"))
    return grouped.select(F.col("window.start").alias("bucket_start"), "scope", "product_id", "score")


def live_trending(buckets: DataFrame, now: Column, k: int, hours: int = 24, half: float = 6.0) -> DataFrame:
    """Top ``k`` of each scope: whole-hour ages 0 to ``hours - 1`` of the buckets, decayed."""
    age = (F.unix_timestamp(F.date_trunc("hour", now)) - F.unix_timestamp("bucket_start")) / 3600
    recent = buckets.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < hours))
    scored = recent.groupBy("scope", "product_id").agg(F.sum(F.col("score") * F.pow(F.lit(0.5), F.col("age") / half)).alias("score"))
    return top_k(scored, ["scope"], "score", "product_id", k)


def warm_buckets(buckets: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """``buckets`` with batch ``scores (scope, product_id, score)`` added to the current hour."""
    seeded = scores.select(F.date_trunc("hour", now).alias("bucket_start"), "scope", "product_id", "score")
    return buckets.unionByName(seeded).groupBy("bucket_start", "scope", "product_id").agg(F.sum("score").alias("score"))


def session_products(events: DataFrame, cap: int = 50) -> DataFrame:
    """Each session's latest products, newest first, repeats kept."""
    w = W.partitionBy("session_key").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    looked = events.filter(F.col("event_type").isin("PRODUCT_VIEW", "PRODUCT_CLICK") & F.col("product_id").isNotNull())
    return looked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("session_key", "product_id", "rank")


def recently_viewed(events: DataFrame, cap: int = 50) -> DataFrame:
    """Each user's latest distinct products; seeing one again moves it to the front."""
    looked = events.filter((F.col("event_type") == "PRODUCT_VIEW") & F.col("product_id").isNotNull() & F.col("user_id").isNotNull())
    last = looked.groupBy("user_id", "product_id").agg(F.max(F.struct("occurred_at", "event_id")).alias("last"))
    w = W.partitionBy("user_id").orderBy(F.desc("last"))
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("user_id", "product_id", "rank")


def roll_up_sessions(events: DataFrame) -> DataFrame:
    """One row a session: first known user, first known device, first and last time, events, converted."""
    order = F.struct("occurred_at", "event_id")
    known = F.when(F.col("device_type") != "unknown", F.col("device_type"))
    return events.groupBy("session_key").agg(
        F.min_by("user_id", F.when(F.col("user_id").isNotNull(), order)).alias("user_id"),
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), order)), F.lit("unknown")).alias("device_type"),
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("ended_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.bool_or(F.col("event_type") == "PURCHASE").alias("converted"),
    )


def merge_sessions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored sessions with a batch's: the stored user and known device win, times widen, counts add."""
    a, b = stored.alias("a"), batch.alias("b")
    known = F.when(F.col("a.device_type") != "unknown", F.col("a.device_type"))
    return a.join(b, F.col("a.session_key") == F.col("b.session_key"), "full_outer").select(
        F.coalesce("a.session_key", "b.session_key").alias("session_key"),
        F.coalesce("a.user_id", "b.user_id").alias("user_id"),
        F.coalesce(known, F.col("b.device_type"), F.lit("unknown")).alias("device_type"),
        F.least("a.started_at", "b.started_at").alias("started_at"),
        F.greatest("a.ended_at", "b.ended_at").alias("ended_at"),
        (F.coalesce("a.event_count", F.lit(0)) + F.coalesce("b.event_count", F.lit(0))).alias("event_count"),
        (F.coalesce("a.converted", F.lit(False)) | F.coalesce("b.converted", F.lit(False))).alias("converted"),
    )


def stitch(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events without a user get the one their session turned out to have."""
    owner = sessions.select("session_key", F.col("user_id").alias("_owner"))
    return events.join(owner, "session_key", "left").withColumn("user_id", F.coalesce("user_id", "_owner")).drop("_owner")


def deduplicate(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One event for each id: the earliest."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), "occurred_at").alias("e")).select(key, "e.*")


def split_feedback(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Impressions and clicks of recommendations, kept apart from the users' own events."""
    fed = events.filter(F.col("recommendation_id").isNotNull())
    keep = ["recommendation_id", "user_id", "product_id", "occurred_at"]
    return fed.filter("event_type = 'PRODUCT_VIEW'").select(*keep), fed.filter("event_type = 'PRODUCT_CLICK'").select(*keep)


def over_limit(requests: DataFrame, limit: int, identity: str = "user_id", at: str = "occurred_at") -> DataFrame:
    """Identities with more than ``limit`` requests in a minute."""
    counts = requests.groupBy(F.window(at, "1 minute").alias("w"), identity).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select(F.unix_micros("w.start").alias("minute_us"), identity, "n")
