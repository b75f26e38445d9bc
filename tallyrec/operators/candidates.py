"""Candidate sources, fusion and rules (stage 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import BUDGETS
from tallyrec.functions.columns import stable_bucket, top_k
from tallyrec.operators.cooccurrence import recommend as from_neighbours

COLUMNS = ["user_id", "product_id", "score", "rank"]


def contexts(rows: DataFrame, keep: int = 20, recency: str = "last") -> DataFrame:
    """Each user's recent distinct products, newest first (``rank`` from 1), by last or by first touch."""
    touch = F.max if recency == "last" else F.min
    at = rows.groupBy("user_id", "product_id").agg(touch("occurred_at").alias("at"))
    w = W.partitionBy("user_id").orderBy(F.desc("at"), "product_id")
    return at.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("user_id", "product_id", "rank")


def model_source(scores: DataFrame, budget: int) -> DataFrame:
    """A model's best, ranked from 0."""
    return top_k(scores, ["user_id"], "score", "product_id", budget).withColumn("rank", F.col("rank") - 1).select(*COLUMNS)


def neighbour_source(recent: DataFrame, edges: DataFrame, exclude: DataFrame, budget: int, anchors: int = 10) -> DataFrame:
    return from_neighbours(recent, edges, exclude, budget, anchors=anchors).withColumn("rank", F.col("rank") - 1).select(*COLUMNS)


def affinity_source(affinities: DataFrame, ranked: DataFrame, level: str, exclude: DataFrame, budget: int, keys: int) -> DataFrame:
    """The best of each user's top ``keys`` categories (or brands): the largest affinity times score."""
    top = affinities.filter(F.col("rank") <= keys).select("user_id", F.col("key_id").alias(level), "affinity")
    scored = top.join(ranked.select(level, "product_id", "score"), level).groupBy("user_id", "product_id").agg(F.max(F.col("affinity") * F.col("score")).alias("score"))
    return model_source(without(scored, exclude), budget)


def static_source(ranked: DataFrame, users: DataFrame, exclude: DataFrame, budget: int) -> DataFrame:
    """A common list less what each user is to be spared, ranked anew.

    The list each user sees is cut at the budget plus what the user excludes, which can't change the result.
    """
    spared = exclude.groupBy("user_id").agg(F.countDistinct("product_id").alias("n"))
    sized = users.select("user_id").join(spared, "user_id", "left").withColumn("upto", F.coalesce("n", F.lit(0)) + budget)
    listed = sized.join(ranked.select("product_id", "score", F.col("rank").alias("place")), F.col("place") <= F.col("upto"))
    return model_source(without(listed.select("user_id", "product_id", "score"), exclude), budget)


def recent_source(recent: DataFrame, exclude: DataFrame, budget: int) -> DataFrame:
    """Recently seen products: 1 less a hundredth a place; places keep their gaps."""
    placed = recent.select("user_id", "product_id", (1 - 0.01 * (F.col("rank") - 1)).alias("score"), (F.col("rank") - 1).alias("rank"))
    return without(placed, exclude).filter(F.col("rank") < budget)


def exploration_source(cold: DataFrame, users: DataFrame, exclude: DataFrame, budget: int, seed: int = 42, slots: int | None = None) -> DataFrame:
    """Cold products in an order that a hash gives each user.

    Products are dealt into ``slots`` and a user draws from one slot only.  There are as many slots as
    leave about ``8 * budget`` products in each, so a user meets no more of them however long the catalogue is.
    """
    slots = slots or max(1, cold.count() // (8 * budget))
    slot = lambda c: stable_bucket(F.concat(F.lit(f"{seed}:"), c.cast("string")), slots)
    dealt = cold.select("product_id").withColumn("slot", slot(F.col("product_id")))
    drawn = users.select("user_id").withColumn("slot", slot(F.col("user_id"))).join(dealt, "slot")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("product_id").cast("string")), 256)
    fresh = without(drawn.select("user_id", "product_id").withColumn("order", order), exclude)
    w = W.partitionBy("user_id").orderBy("order")
    return fresh.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < budget).select("user_id", "product_id", F.lit(0.01).alias("score"), "rank")


def without(rows: DataFrame, exclude: DataFrame) -> DataFrame:
    return rows.join(exclude.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")


def gather(sources: dict[str, DataFrame], budgets: dict[str, int] | None = None) -> DataFrame:
    """All sources in one table, each within its budget; a source that is None is left out."""
    budgets = budgets or BUDGETS
    out = None
    for name, rows in sources.items():
        if rows is not None:
            one = rows.filter(F.col("rank") < budgets[name]).select("user_id", "product_id", F.lit(name).alias("source"), "score", "rank")
            out = one if out is None else out.unionByName(one)
    return out


def fuse(gathered: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion, with how many sources agree and which."""
    return gathered.groupBy("user_id", "product_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("fused"), F.array_sort(F.collect_set("source")).alias("names")).select("user_id", "product_id", "fused", F.size("names").cast("long").alias("agreement"), F.array_join("names", ",").alias("sources"))


def allowed(fused: DataFrame, products: DataFrame, purchased: DataFrame, consumable: float = 0.30) -> DataFrame:
    """Active and in stock; not bought before, unless it is bought again by nature."""
    good = products.filter(F.col("is_active") & (F.col("stock_quantity") > 0)).select(F.col("id").alias("product_id"), "repeat_rate")
    had = purchased.select("user_id", "product_id").distinct().withColumn("had", F.lit(True))
    joined = fused.join(good, "product_id").join(had, ["user_id", "product_id"], "left")
    return joined.filter(F.col("had").isNull() | (F.col("repeat_rate") >= consumable)).drop("had", "repeat_rate")


def near_in_price(fused: DataFrame, products: DataFrame, users: DataFrame, most: float = 0.55) -> DataFrame:
    """Products whose price percentile is not too far from the user's."""
    both = fused.join(products.select("product_id", "price_percentile"), "product_id").join(users.select("user_id", "price_percentile_mean"), "user_id")
    return both.filter(F.abs(F.col("price_percentile") - F.col("price_percentile_mean")) <= most).drop("price_percentile", "price_percentile_mean")


def pool(fused: DataFrame, size: int = 300) -> DataFrame:
    return top_k(fused, ["user_id"], "fused", "product_id", size)


def provenance(gathered: DataFrame) -> DataFrame:
    """For each candidate its score and rank by source, as maps."""
    return gathered.groupBy("user_id", "product_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "score"))).alias("scores"), F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("ranks"))


def recall(pooled: DataFrame, wanted: DataFrame) -> DataFrame:
    """Mean over users with targets of the share that the pool holds; no pool counts 0."""
    hits = wanted.join(pooled.select("user_id", "product_id").withColumn("hit", F.lit(1.0)), ["user_id", "product_id"], "left")
    return hits.groupBy("user_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(F.avg("r").alias("recall"), F.count(F.lit(1)).alias("users"))


def contribution(gathered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which share of all targets each source found, before the pool is cut."""
    total = wanted.agg(F.count(F.lit(1)).cast("double").alias("total"))
    hits = gathered.select("user_id", "product_id", "source").join(wanted, ["user_id", "product_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(F.broadcast(total)).select("source", "hits", (F.col("hits") / F.col("total")).alias("share"))
