"""Collaborative filtering by implicit alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import minmax_within, stable_bucket, top_k
from tallyrec.operators.content import dot, similar
from tallyrec.session import checkpointed, written


def supported(weights: DataFrame, least: int = 2) -> DataFrame:
    """Rows of items that at least ``least`` users touched."""
    good = weights.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("product_id")
    return weights.join(good, "product_id", "left_semi")


def dense_index(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct ids with the dense integers 0, 1, ... in their order.

    Ids are sorted over many tasks; a task's offset is the sum of the counts before it, one row a task.
    """
    # checkpointed, as another run of the sort could deal the ids out otherwise
    ordered = checkpointed(ids.select(column).distinct().sort(column)).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part], total = total, total + counts[part]
    if total > 2**31 - 1:
        raise ValueError("too many ids for the factor model")
    shift = ids.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "part int, shift long")
    return ordered.join(F.broadcast(shift), "part").select(column, (F.col("shift") + F.col("at")).cast("int").alias(out))


class Factors:
    """User and item factors under the original ids."""

    def __init__(self, users: DataFrame, items: DataFrame):
        self.users, self.items = users, items


def fit(weights: DataFrame, *, factors: int = 64, rounds: int = 20, regularisation: float = 0.1, alpha: float = 2.0, seed: int = 42) -> Factors:
    """``weights (user_id, product_id, weight)``: confidence ``1 + alpha * weight``."""
    als = ALS(userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, rank=factors, alpha=alpha, regParam=regularisation, maxIter=rounds, seed=seed, coldStartStrategy="drop")
    as_double = F.col("features").cast("array<double>").alias("vector")
    rating = F.col("weight").cast("float").alias("r")
    weights = checkpointed(weights.select("user_id", "product_id", "weight"))  # read for the ids' bounds and for the fit
    ends = weights.agg(F.least(F.min("user_id"), F.min("product_id")).alias("lo"), F.greatest(F.max("user_id"), F.max("product_id")).alias("hi")).first()
    if ends["lo"] is not None and ends["lo"] >= 0 and ends["hi"] < 2**31:
        # the model's ids are integers; where the own ids are such, no index is needed
        model = als.fit(weights.select(F.col("user_id").cast("int").alias("u"), F.col("product_id").cast("int").alias("i"), rating))
        return Factors(*[f.select(F.col("id").cast(weights.schema[c].dataType).alias(c), as_double) for f, c in ((model.userFactors, "user_id"), (model.itemFactors, "product_id"))])
    users, items = dense_index(weights, "user_id", "u"), dense_index(weights, "product_id", "i")
    model = als.fit(weights.join(users, "user_id").join(items, "product_id").select("u", "i", rating))
    return Factors(
        model.userFactors.join(users, F.col("id") == F.col("u")).select("user_id", as_double),
        model.itemFactors.join(items, F.col("id") == F.col("i")).select("product_id", as_double),
    )


def fold_in(factors: Factors, touched: DataFrame) -> DataFrame:
    """User vectors; users the model doesn't know get the mean of the items they touched."""
    unknown = touched.join(factors.users.select("user_id"), "user_id", "left_anti")
    cells = unknown.join(factors.items, "product_id").select("user_id", F.posexplode("vector").alias("at", "x")).groupBy("user_id", "at").agg(F.avg("x").alias("x"))
    mean = cells.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    return factors.users.unionByName(mean)


def recommend(users: DataFrame, factors: Factors, seen: DataFrame, k: int) -> DataFrame:
    """Each user's ``k`` best unseen items by factor product, 0 to 1 over the list."""
    from tallyrec.operators.content import recommend as nearest

    return nearest(users, factors.items, seen, k)


def score(candidates: DataFrame, factors: Factors) -> DataFrame:
    met = candidates.join(factors.users.withColumnRenamed("vector", "u"), "user_id", "left").join(factors.items.withColumnRenamed("vector", "v"), "product_id", "left")
    return met.withColumn("collaborative_score", F.coalesce(dot(F.col("u"), F.col("v")), F.lit(0.0))).drop("u", "v")


def similar_items(factors: Factors, k: int) -> DataFrame:
    """Nearest items by cosine in factor space."""
    return similar(factors.items, k)


#: Positives of one slot that a group of the join holds.
DRAWN = 10_000


def triples(weights: DataFrame, each: int = 3, slots: int | None = None, seed: int = 42) -> DataFrame:
    """(user, positive, negative) samples for pairwise training: negatives are items the user never touched.

    A positive draws from one slot of the items, chosen by hash.  There are as many slots as leave about
    ``16 * each`` items in each, so a positive meets no more of them however many items there are.  A slot's positives
    are dealt into groups of about ``DRAWN``, each with the slot's items in one row, so that few items don't mean few tasks.
    What a user has touched of a slot comes along with the positive, and the draw is made within its row: no pair of a positive
    and an item is exchanged.
    """
    weights = written(weights.select("user_id", "product_id"), "touched")
    slots = slots or max(1, weights.select("product_id").distinct().count() // (16 * each))
    slot = lambda key: stable_bucket(F.concat(F.lit(f"{seed}:"), key), slots)
    of_item = slot(F.col("product_id").cast("string"))
    items = weights.select("product_id").distinct().groupBy(of_item.alias("slot")).agg(F.collect_list("product_id").alias("items"))
    touched = weights.groupBy("user_id", of_item.alias("slot")).agg(F.collect_list("product_id").alias("touched"))
    drawn = weights.select("user_id", F.col("product_id").alias("positive")).withColumn("slot", slot(F.concat_ws("-", F.col("user_id").cast("string"), F.col("positive").cast("string"))))
    n = weights.count()
    groups, tasks = max(1, n // (slots * DRAWN)), max(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (5 * DRAWN))
    known = drawn.join(touched, ["user_id", "slot"], "left")
    dealt = known.withColumn("group", F.pmod(F.xxhash64("user_id", "positive"), F.lit(groups)).cast("int")).repartition(tasks, "slot", "group")
    copies = items.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    fresh = dealt.join(copies, ["slot", "group"]).withColumn("fresh", F.array_except("items", F.coalesce("touched", F.array().cast(items.schema["items"].dataType))))
    order = lambda x: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("positive").cast("string"), x.cast("string")), 256)
    best = F.slice(F.array_sort(F.transform("fresh", lambda x: F.struct(order(x).alias("order"), x.alias("negative")))), 1, each)
    return fresh.select("user_id", "positive", F.explode(best).alias("x")).select("user_id", "positive", F.col("x.negative").alias("negative"))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", minmax_within(F.col("score"), ["user_id"]))
