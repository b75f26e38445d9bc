"""Blending, diversity, fallback and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import BLEND_WEIGHTS, COMPONENTS
from tallyrec.functions.columns import minmax_within, top_k

#: source -> (reason, priority, template).  The highest priority a product has is shown.
REASONS = {
    "frequently_bought": ("bought_together", 90, "Often bought with {anchor}"),
    "covisitation": ("viewed_together", 80, "People who viewed {anchor} also viewed this"),
    "recently_viewed": ("seen_lately", 75, "You looked at this recently"),
    "category_affinity": ("category", 60, "Because you like {category}"),
    "brand_affinity": ("brand", 55, "From {brand}, a brand you like"),
    "collaborative": ("similar_people", 50, "Liked by people with similar taste"),
    "content": ("similar_item", 45, "Similar to {anchor}"),
    "trending": ("trending", 30, "Trending now"),
    "popularity": ("popular", 20, "Popular with shoppers"),
    "exploration": ("new", 10, "New to you"),
}
GENERIC = ("generic", "Recommended for you")


def regime(count: Column) -> Column:
    """How much history a user has: cold, sparse, warm or rich."""
    return F.when(count < 1, "cold").when(count < 5, "sparse").when(count < 20, "warm").otherwise("rich")


def blend(components: DataFrame, counts: DataFrame) -> DataFrame:
    """Weighted sum of the components' scores by the user's regime, with the breakdown.

    ``components (user_id, product_id, component, score)``, each already 0 to 1 a list;
    ``counts (user_id, n)``.
    """
    share = F.lit(0.0)
    for name, weights in BLEND_WEIGHTS.items():
        for component, weight in zip(COMPONENTS, weights, strict=True):
            share = F.when((F.col("regime") == name) & (F.col("component") == component), weight).otherwise(share)
    known = components.join(counts, "user_id", "left").withColumn("regime", regime(F.coalesce("n", F.lit(0))))
    parts = known.withColumn("part", share * F.col("score"))
    return parts.groupBy("user_id", "product_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.collect_list(F.struct("component", "part"))).alias("parts"), F.first("regime").alias("regime"))


def component_scores(lists: dict[str, DataFrame]) -> DataFrame:
    """Each model's own list, 0 to 1 a user, in one table."""
    out = None
    for name, rows in lists.items():
        one = rows.select("user_id", "product_id", F.lit(name).alias("component"), minmax_within(F.col("score"), ["user_id"]).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def boost_novelty(scores: DataFrame, novelty: DataFrame, boost: float = 0.15) -> DataFrame:
    """Scores times ``1 + boost * novelty``; a product without novelty counts as 0.5."""
    return scores.join(novelty.select("product_id", "novelty_score"), "product_id", "left").withColumn("score", F.col("score") * (1 + boost * F.coalesce("novelty_score", F.lit(0.5)))).drop("novelty_score")


def diversify(ranked: DataFrame, k: int, *, relevance: float = 0.72, per_category: int = 4, per_brand: int = 3) -> DataFrame:
    """Maximal marginal relevance with caps on category and brand, then a top-up by relevance.

    ``ranked (user_id, product_id, score, category_id, brand_id)``.  Choosing is sequential
    within a user, so each user's list is a group; users are independent.  Products of the same
    category and brand differ by score alone, so only as many of them as the caps let in can be chosen,
    and beyond those only the ``k`` best of all, for the top-up: these come to the group, however long the list is.
    """

    def choose(frame):
        import pandas as pd

        left = frame.sort_values(["score", "product_id"], ascending=[False, True]).reset_index(drop=True)
        category, brand = (pd.factorize(left[c], use_na_sentinel=False)[0] for c in ("category_id", "brand_id"))
        score, free = left["score"].to_numpy(float), np.ones(len(left), bool)
        of_category, of_brand = np.zeros(len(left) + 1), np.zeros(len(left) + 1)
        taken = []
        for n in range(min(k, len(left))):
            fits = free & (of_category[category] < per_category) & (of_brand[brand] < per_brand)
            value = relevance * score - (1 - relevance) * of_category[category] / max(n, 1)
            # none is eligible: the most relevant one fills up
            at = int(np.argmax(np.where(fits, value, -np.inf))) if fits.any() else int(np.argmax(free))
            free[at] = False
            of_category[category[at]] += 1
            of_brand[brand[at]] += 1
            taken.append(at)
        out = left.iloc[taken][["user_id", "product_id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    order = [F.desc("score"), F.asc("product_id")]
    same = F.row_number().over(W.partitionBy("user_id", "category_id", "brand_id").orderBy(*order))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    short = ranked.withColumn("_same", same).withColumn("_place", place).filter((F.col("_same") <= min(per_category, per_brand)) | (F.col("_place") <= k))
    return short.select("user_id", "product_id", "score", "category_id", "brand_id").groupBy("user_id").applyInPandas(choose, "user_id long, product_id long, score double, rank int")


def cap_groups(ranked: DataFrame, k: int, *, per_category: int = 4, per_brand: int = 3) -> DataFrame:
    """Only the caps: the best of each category and brand, then the best ``k``."""
    order = [F.desc("score"), F.asc("product_id")]
    capped = ranked.withColumn("_c", F.row_number().over(W.partitionBy("user_id", "category_id").orderBy(*order))).withColumn("_b", F.row_number().over(W.partitionBy("user_id", "brand_id").orderBy(*order)))
    return top_k(capped.filter((F.col("_c") <= per_category) & (F.col("_b") <= per_brand)).drop("_c", "_b"), ["user_id"], "score", "product_id", k)


def fallback(rungs: list[tuple[str, DataFrame]], users: DataFrame, k: int) -> DataFrame:
    """The first rung that gives a user ``k`` items, or else the fullest of the best; ``strategy`` says which."""
    rows = None
    for level, (name, df) in enumerate(rungs):
        one = df.select("user_id", "product_id", "score", F.lit(level).alias("level"), F.lit(name).alias("strategy"))
        rows = one if rows is None else rows.unionByName(one)
    listed = top_k(rows.join(users.select("user_id"), "user_id", "left_semi"), ["user_id", "level"], "score", "product_id", k)
    sizes = listed.groupBy("user_id", "level").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("user_id").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("level"))
    return listed.join(chosen, ["user_id", "level"]).drop("level")


def static_scores(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", 1 - 0.001 * (F.col("rank") - 1))


def similar_or(first: DataFrame, second: DataFrame) -> DataFrame:
    """Neighbours of ``first (item, neighbour, score)``; of ``second`` for items it has none for."""
    return first.unionByName(second.join(first.select("item").distinct(), "item", "left_anti"))


def because_you_viewed(recent: DataFrame, similar: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Neighbours of each user's latest item, less what was seen."""
    anchor = recent.filter("rank = 1").select("user_id", F.col("product_id").alias("item"))
    near = anchor.join(similar.select("item", F.col("neighbour").alias("product_id"), "score"), "item")
    fresh = near.join(seen.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")
    return top_k(fresh, ["user_id"], "score", "product_id", k)


def home_page(sections: dict[str, DataFrame], k: int) -> DataFrame:
    """All sections of all users in one table; empty ones aren't there."""
    rows = None
    for name, df in sections.items():
        one = top_k(df, ["user_id"], "score", "product_id", k, "position").select("user_id", F.lit(name).alias("section"), "position", "product_id", "score")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def recent_products(session_lists: DataFrame, account_lists: DataFrame) -> DataFrame:
    """The session's list where there is one, the account's otherwise."""
    return session_lists.unionByName(account_lists.join(session_lists.select("user_id").distinct(), "user_id", "left_anti"))


def reason_of(sources: Column, parts: Column | None = None, surface: Column | None = None) -> Column:
    """The reason's name: the surface's own, the best source's, the main component's, or a generic one."""
    best = F.lit(GENERIC[0])
    if parts is not None:
        top = F.array_max(F.transform(F.map_entries(parts), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
        for source, (reason, _, _) in REASONS.items():
            best = F.when(top == source, reason).otherwise(best)
    for _source, (reason, _, _) in sorted(REASONS.items(), key=lambda x: x[1][1]):
        best = F.when(F.array_contains(sources, _source), reason).otherwise(best)
    return F.coalesce(surface, best) if surface is not None else best


def reason_text(reason: Column, anchor: Column, category: Column, brand: Column) -> Column:
    """The reason in words; a missing name gives the generic text."""
    out = F.lit(GENERIC[1])
    for name, _, template in REASONS.values():
        text = F.lit(template)
        for key, value in (("{anchor}", anchor), ("{category}", category), ("{brand}", brand)):
            if key in template:
                text = F.replace(text, F.lit(key), value)
        out = F.when(reason == name, F.coalesce(text, F.lit(GENERIC[1]))).otherwise(out)
    return out


def confidence(sources: Column, parts: Column) -> Column:
    strongest = F.coalesce(F.array_max(F.map_values(parts)), F.lit(0.0))
    return F.round(0.6 * F.least(F.size(sources) / 3.0, F.lit(1.0)) + 0.4 * F.least(strongest, F.lit(1.0)), 4)


def explain_pairs(asked: DataFrame, ranked: DataFrame, upto: int = 100) -> DataFrame:
    """Where each asked (user, product) stands; ``recommended`` is false beyond ``upto``."""
    listed = ranked.filter(F.col("rank") <= upto).select("user_id", "product_id", "rank", "score")
    return asked.join(listed, ["user_id", "product_id"], "left").withColumn("recommended", F.col("rank").isNotNull())


def distribution(recs: DataFrame, level: str) -> DataFrame:
    """How often each value of ``level`` is recommended, and to which share of users."""
    users = recs.agg(F.countDistinct("user_id").cast("double").alias("users"))
    counts = recs.groupBy(F.col(level).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("reached"))
    return counts.crossJoin(F.broadcast(users)).select("key", "n", (F.col("reached") / F.col("users")).alias("share_of_users"))
