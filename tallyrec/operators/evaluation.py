"""Offline evaluation: recommendations ``(model, user_id, product_id, rank)`` against targets ``(user_id, product_id[, gain])``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import GRADES
from tallyrec.functions.columns import mapped, stable_bucket


def graded_targets(folds: DataFrame, fold: str) -> DataFrame:
    rows = folds.filter(F.col("fold") == fold).withColumn("gain", mapped(F.col("event_type"), GRADES, 0)).filter("gain > 0")
    return rows.groupBy("user_id", "product_id").agg(F.max("gain").alias("gain"))


def sample_users(targets: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` users, in a hash's order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")), 256)
    return targets.select("user_id").distinct().orderBy(key, "user_id").limit(most)


def segments(train: DataFrame, users: DataFrame) -> DataFrame:
    n = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0))
    return users.select("user_id").distinct().join(n, "user_id", "left").select("user_id", F.when(count < 1, "cold").when(count < 5, "sparse").when(count < 20, "warm").otherwise("rich").alias("segment"))


def ideal_gain(n: Column) -> Column:
    """Sum of ``1 / log2(i + 1)`` for i up to ``n``."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= n, 1 / F.log2(i + 1.0)).otherwise(0.0))


def accuracy(recs: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, average precision, NDCG, graded NDCG, hit and reciprocal rank of each (model, user).

    Every user with targets counts, for every model; without a list all are 0.
    """
    gained = targets if "gain" in targets.columns else targets.withColumn("gain", F.lit(1))
    truth = gained.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("gain"), "product_id")))
    power = F.pow(F.lit(2.0), F.col("gain")) - 1
    wanted = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("place") <= k, power / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("ideal"))
    models = recs.select("model").distinct()
    hits = recs.filter(F.col("rank") <= max(k, 20)).join(gained.select("user_id", "product_id", "gain"), ["user_id", "product_id"])
    so_far = F.row_number().over(W.partitionBy("model", "user_id").orderBy("rank"))
    hits = hits.withColumn("so_far", so_far)
    top = F.col("rank") <= k
    each = hits.groupBy("model", "user_id").agg(
        F.sum(top.cast("int")).alias("hits"),
        F.sum(F.when(top, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top, power / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("graded"),
        F.min("rank").alias("first"),
    )
    base = wanted.crossJoin(F.broadcast(models)).join(each, ["model", "user_id"], "left").fillna(0, ["hits", "ap", "dcg", "graded"])
    short = F.least("n_relevant", F.lit(k))
    return base.select(
        "model",
        "user_id",
        (F.col("hits") / F.lit(float(k))).alias("precision"),
        (F.col("hits") / F.col("n_relevant")).alias("recall"),
        (F.col("ap") / short).alias("map"),
        (F.col("dcg") / ideal_gain(short)).alias("ndcg"),
        (F.col("graded") / F.col("ideal")).alias("graded_ndcg"),
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


METRICS = ("precision", "recall", "map", "ndcg", "graded_ndcg", "hit", "mrr")


def means(per_user: DataFrame, segment: DataFrame | None = None) -> DataFrame:
    """Means of each model, overall (``segment`` = all) and by segment, in one pass."""
    rows = per_user.withColumn("segment", F.lit("none")) if segment is None else per_user.join(segment, "user_id")
    sets = rows.groupingSets([["model"], ["model", "segment"]] if segment is not None else [["model"]], "model", "segment")
    return sets.agg(F.count(F.lit(1)).alias("users"), *[F.avg(m).alias(m) for m in METRICS]).withColumn("segment", F.coalesce("segment", F.lit("all")))


def comparison(scored: DataFrame) -> DataFrame:
    return scored.filter("segment = 'all'").drop("segment").orderBy(F.desc("ndcg"), "model")


def by_segment(scored: DataFrame, metric: str = "ndcg") -> DataFrame:
    return scored.groupBy("model").pivot("segment", ["all", "cold", "sparse", "warm", "rich"]).agg(F.first(metric))


def coverage(recs: DataFrame, catalogue: int, k: int = 10) -> DataFrame:
    return recs.filter(F.col("rank") <= k).groupBy("model").agg((F.countDistinct("product_id") / F.lit(float(catalogue))).alias("coverage"))


def intra_list_diversity(recs: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """1 less the share of pairs of a list that share a category; from counts, not pairs."""
    keyed = recs.filter(F.col("rank") <= k).join(products.select(F.col("id").alias("product_id"), "category_id"), "product_id")
    counts = keyed.groupBy("model", "user_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("model", "user_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum("n").alias("total"))
    pairs = F.col("total") * (F.col("total") - 1) / 2
    return lists.groupBy("model").agg(F.avg(F.when(pairs > 0, 1 - F.col("same") / pairs).otherwise(0.0)).alias("diversity"))


def novelty(recs: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """Mean surprise ``-log2(share in train)``; 0 for products not in train."""
    total = train.agg(F.count(F.lit(1)).cast("double").alias("total"))
    share = train.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("product_id", (-F.log2(F.col("n") / F.col("total"))).alias("surprise"))
    each = recs.filter(F.col("rank") <= k).join(share, "product_id", "left").groupBy("model", "user_id").agg(F.avg(F.coalesce("surprise", F.lit(0.0))).alias("s"))
    return each.groupBy("model").agg(F.avg("s").alias("novelty"))


def serendipity(recs: DataFrame, targets: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """Relevant items of the top ``k`` that the baseline's top ``k`` doesn't hold, over ``k``."""
    obvious = baseline.filter(F.col("rank") <= k).select("user_id", "product_id").distinct()
    top = recs.filter(F.col("rank") <= k)
    hits = top.join(targets.select("user_id", "product_id").distinct(), ["user_id", "product_id"]).join(obvious, ["user_id", "product_id"], "left_anti")
    lists = top.select("model", "user_id").distinct().join(hits.groupBy("model", "user_id").agg(F.count(F.lit(1)).alias("n")), ["model", "user_id"], "left")
    return lists.groupBy("model").agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("serendipity"))


def gini(counts: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Gini index of ``value``: equal counts are grouped first, so no global sort of items is needed."""
    bins = counts.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if by else F.coalesce(F.sum("m").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2
    sums = bins.withColumn("ranked", ranks * F.col(value)).groupBy(*by).agg(F.sum("ranked").alias("r"), F.sum(F.col("m") * F.col(value)).alias("s"), F.sum("m").alias("n"))
    return sums.select(*by, F.when(F.col("s") > 0, 2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def exposure_gini(recs: DataFrame, k: int = 10) -> DataFrame:
    return gini(recs.filter(F.col("rank") <= k).groupBy("model", "product_id").agg(F.count(F.lit(1)).alias("n")), ["model"])


def personalisation(recs: DataFrame, k: int = 10, most: int = 400, seed: int = 42) -> DataFrame:
    """Mean Jaccard distance between the lists of ``most`` users chosen by hash (a bounded sample, so its pairs are bounded)."""
    chosen = sample_users(recs, most, seed)
    top = recs.filter(F.col("rank") <= k).join(chosen, "user_id", "left_semi").select("model", "user_id", "product_id").distinct()
    sizes = top.groupBy("model", "user_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = top.alias("a"), top.alias("b")
    met = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.product_id") == F.col("b.product_id")) & (F.col("a.user_id") < F.col("b.user_id")))
    shared = met.groupBy(F.col("a.model").alias("model"), F.col("a.user_id").alias("u"), F.col("b.user_id").alias("v")).agg(F.count(F.lit(1)).alias("both"))
    near = shared.join(sizes.select("model", F.col("user_id").alias("u"), F.col("n").alias("n_u")), ["model", "u"]).join(sizes.select("model", F.col("user_id").alias("v"), F.col("n").alias("n_v")), ["model", "v"])
    total = near.groupBy("model").agg(F.sum(F.col("both") / (F.col("n_u") + F.col("n_v") - F.col("both"))).alias("likeness"))
    people = sizes.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return people.join(total, "model", "left").select("model", F.when(pairs > 0, 1 - F.coalesce("likeness", F.lit(0.0)) / pairs).otherwise(0.0).alias("personalisation"))


def personalisation_of_all(recs: DataFrame, k: int = 10, hashes: int = 128) -> DataFrame:
    """Mean Jaccard distance between the lists of all users, with its standard error.

    Two sets have the same least hash with a chance that is their Jaccard likeness, so the likeness of two users drawn at random is the chance
    that theirs collide: counted by value for each of ``hashes`` functions, without forming a pair.
    """
    lists = recs.filter(F.col("rank") <= k).groupBy("model", "user_id").agg(F.collect_set("product_id").alias("items"))
    least = F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda i: F.array_min(F.transform("items", lambda x: F.xxhash64(i, x))))
    values = lists.select("model", F.posexplode(least).alias("function", "value")).groupBy("model", "function", "value").agg(F.count(F.lit(1)).alias("n"))
    n, pairs = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1).cast("double"))
    chances = values.groupBy("model", "function").agg(F.try_divide(pairs, n * (n - 1)).alias("chance"))
    out = chances.groupBy("model").agg(F.avg("chance").alias("likeness"), (F.stddev_samp("chance") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    return out.select("model", F.when(F.col("likeness").isNull(), 0.0).otherwise(1 - F.col("likeness")).alias("personalisation"), F.coalesce("error", F.lit(0.0)).alias("standard_error"))


def evaluation_part(user: Column, seed: int = 42) -> Column:
    return stable_bucket(F.concat(F.lit(f"{seed}:"), user.cast("string")))
