"""Popularity and trending models as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import minmax_all, minmax_groups, minmax_within, steady_sum, top_k
from tallyrec.operators.features import trending_score


def top_items(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best items over all, ranked; only ``k`` rows of each task reach the ranking."""
    best = scores.orderBy(F.desc("score"), "product_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "product_id")))


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("product_id").agg(F.log1p(steady_sum(F.col("weight"))).alias("score"))


def popular_scores(weights: DataFrame) -> DataFrame:
    """Min-max of ln(1 + summed weight) of every product that has a weight (``product_id, score``)."""
    return minmax_all(_summed(weights), "score", 1.0)


def popular(weights: DataFrame, k: int = 5000) -> DataFrame:
    """The ``k`` best of :func:`popular_scores`."""
    return top_items(popular_scores(weights), k)


def popular_by_category(weights: DataFrame, products: DataFrame, k: int | None = None) -> DataFrame:
    keyed = _summed(weights).join(products.select(F.col("id").alias("product_id"), "category_id"), "product_id")
    scored = minmax_groups(keyed, "score", "category_id")
    return top_k(scored, ["category_id"], "score", "product_id", k) if k else scored


def trending(rows: DataFrame, as_of: Column, k: int = 2000, *, window_hours: float = 168, half_life_hours: float = 42) -> DataFrame:
    """Offline trending: the window and the half-life are seven times those of the live one."""
    scores = trending_score(rows, as_of, window_hours, half_life_hours).filter("score > 0")
    return top_items(minmax_all(scores, "score", 1.0), k)


def trending_by_category(rows: DataFrame, products: DataFrame, as_of: Column, k: int | None = None, *, window_hours: float = 168, half_life_hours: float = 42) -> DataFrame:
    scores = trending_score(rows, as_of, window_hours, half_life_hours).filter("score > 0")
    keyed = minmax_groups(scores.join(products.select(F.col("id").alias("product_id"), "category_id"), "product_id"), "score", "category_id")
    return top_k(keyed, ["category_id"], "score", "product_id", k) if k else keyed


def recommend(affinities: DataFrame, by_category: DataFrame, overall: DataFrame, seen: DataFrame, users: DataFrame, k: int, share: float = 0.15) -> DataFrame:
    """Each user's ``k`` best by affinity times category score plus ``share`` of the overall score.

    Users without affinities get the overall list.  Outside a user's categories only the
    overall top ``k`` and as many more as this user has seen can matter, so a user meets no more of the list.
    ``overall (product_id, score, rank)`` is a ranked list of bounded length.
    """
    met = seen.select("user_id", "product_id").distinct()
    own = affinities.select("user_id", F.col("key_id").alias("category_id"), "affinity").join(by_category.select("category_id", "product_id", "score"), "category_id")
    own = own.select("user_id", "product_id", (F.col("affinity") * F.col("score")).alias("part"))
    known = affinities.select("user_id").distinct().withColumn("known", F.lit(True))
    reach = users.select("user_id").distinct().join(met.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + k).cast("int").alias("reach"))
    last = overall.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))
    ranks = F.when(F.col("last") > 0, F.sequence(F.lit(1), F.least("reach", "last")))
    base = reach.join(known, "user_id", "left").crossJoin(F.broadcast(last)).select("user_id", "known", F.explode(ranks).alias("rank"))
    base = base.join(overall.select("rank", "product_id", F.col("score").alias("all_score")), "rank")
    base = base.select("user_id", "product_id", (F.when(F.col("known"), F.lit(share)).otherwise(1.0) * F.col("all_score")).alias("part"))
    # a product of the user's own categories needs its overall share even beyond the user's reach
    extra = own.select("user_id", "product_id").distinct().join(overall.select("product_id", "rank", (share * F.col("score")).alias("part")), "product_id").join(reach, "user_id").filter(F.col("rank") > F.col("reach")).select("user_id", "product_id", "part")
    summed = own.unionByName(base).unionByName(extra).groupBy("user_id", "product_id").agg(F.sum("part").alias("score"))
    fresh = summed.join(met, ["user_id", "product_id"], "left_anti")
    return top_k(fresh, ["user_id"], "score", "product_id", k)


def normalise(lists: DataFrame, keys: list[str]) -> DataFrame:
    return lists.withColumn("score", minmax_within(F.col("score"), keys))


def top_by_group(scores: DataFrame, products: DataFrame, level: str, k: int) -> DataFrame:
    """The ``k`` best products of each group over the whole catalogue; unscored ones count as 0, so ``scores`` has to hold every scored product."""
    every = products.select(F.col("id").alias("product_id"), level).join(scores.select("product_id", "score"), "product_id", "left").fillna(0.0, ["score"])
    return top_k(every, [level], "score", "product_id", k)
