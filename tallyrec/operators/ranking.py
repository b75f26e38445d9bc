"""Ranking data and models (stage 2)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.config import GRADES
from tallyrec.functions.columns import mapped, minmax_within, stable_bucket, top_k
from tallyrec.operators.features import PAIR_FEATURES, PRODUCT_FEATURES, USER_FEATURES

RANKED_SOURCES = ("collaborative", "content", "covisitation", "category_affinity", "trending")
SCORED_SOURCES = ("frequently_bought", "brand_affinity", "popularity", "recently_viewed")
SOURCE_FEATURES = (*(f"source_{s}_{x}" for s in RANKED_SOURCES for x in ("score", "rank")), *(f"source_{s}_score" for s in SCORED_SOURCES), "source_agreement", "candidate_rank")
#: What a pool's rows may have beside their keys and rank.
CARRIED = ("label", "place", "draw")
FEATURES = (*(f"user_{c}" for c in USER_FEATURES), *(f"product_{c}" for c in PRODUCT_FEATURES), *PAIR_FEATURES, *SOURCE_FEATURES)


def labels(rows: DataFrame) -> DataFrame:
    """The highest grade of each (user, product): purchase 3, cart 2, click 1."""
    return rows.groupBy("user_id", "product_id").agg(F.max(mapped(F.col("event_type"), GRADES, 0)).alias("label")).filter("label > 0")


def source_features(gathered: DataFrame, pooled: DataFrame) -> DataFrame:
    """16 columns on where a candidate came from; a missing rank is 999, a missing score 0.  A pool's ``CARRIED`` columns come along."""
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    columns = [x for s in RANKED_SOURCES for x in (F.coalesce(of(s, "score"), F.lit(0.0)).alias(f"source_{s}_score"), F.coalesce(of(s, "rank"), F.lit(999)).alias(f"source_{s}_rank"))]
    columns += [F.coalesce(of(s, "score"), F.lit(0.0)).alias(f"source_{s}_score") for s in SCORED_SOURCES]
    wide = gathered.groupBy("user_id", "product_id").agg(*columns, F.countDistinct("source").alias("source_agreement"))
    own = [c for c in CARRIED if c in pooled.columns]
    return pooled.select("user_id", "product_id", F.col("rank").alias("candidate_rank"), *own).join(wide, ["user_id", "product_id"]).select("user_id", "product_id", *SOURCE_FEATURES, *own)


def assemble(users: DataFrame, products: DataFrame, pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """83 columns in a fixed order for every candidate; ids of category and brand are hashed to numbers.  ``CARRIED`` columns of ``sources`` stay, as the last ones."""
    numbered = lambda df, c: stable_bucket(F.col(c)).cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    u = users.select("user_id", *[F.col(c).cast("double").alias(f"user_{c}") for c in USER_FEATURES])
    p = products.select("product_id", *[numbered(products, c).alias(f"product_{c}") for c in PRODUCT_FEATURES])
    s = sources.join(pairs, ["user_id", "product_id"], "left").join(u, "user_id", "left").join(p, "product_id", "left")
    own = [c for c in CARRIED if c in sources.columns]
    return s.select("user_id", "product_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES], *own)


def with_labels(rows: DataFrame, graded: DataFrame) -> DataFrame:
    return rows.join(graded, ["user_id", "product_id"], "left").fillna(0, ["label"])


def keep_answered(rows: DataFrame) -> DataFrame:
    """Lists with at least one positive."""
    good = rows.filter("label > 0").select("user_id").distinct()
    return rows.join(good, "user_id", "left_semi")


def shuffle_key(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def hashed_share(*columns: Column) -> Column:
    """A number between 0 and 1 from the first four bytes of SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", *[c.cast("string") for c in columns]), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sample_negatives(rows: DataFrame, each: int = 120, seed: int = 42, *, hard: str | None = None) -> DataFrame:
    """All positives, and ``each`` negatives a list: in a hash's order, or, with ``hard``, likelier the nearer they are to the front.

    ``hard`` names the column with a candidate's place (from 1).  Each negative draws an exponential time of rate ``1 / place``
    and the earliest are kept, which is drawing without replacement with chances in proportion to the rates.
    """
    order = [shuffle_key(seed, "user_id", "product_id")]
    if hard is not None:
        order = [-F.log(hashed_share(F.lit(seed), F.col("user_id"), F.col("product_id"))) * F.greatest(F.col(hard).cast("double"), F.lit(1.0)), F.col("product_id")]
    w = W.partitionBy("user_id", F.col("label") > 0).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter((F.col("label") > 0) | (F.col("_n") <= each)).drop("_n")


def fit_or_stop(rows: DataFrame, fit_fraction: float = 0.85, seed: int = 42) -> DataFrame:
    """Each list is wholly in ``fit`` or in ``stop``, by its user's bucket."""
    return rows.withColumn("part", F.when(stable_bucket(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string"))) < int(fit_fraction * 10_000), "fit").otherwise("stop"))


def summary(rows: DataFrame) -> DataFrame:
    lists = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") > 0).cast("double")).alias("p"))
    return lists.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("queries"), (F.sum("p") / F.sum("n")).alias("positive_rate"), F.avg("n").alias("mean_group"))


def _vector(columns) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features_raw", handleInvalid="keep")


def pointwise(rows: DataFrame, columns=FEATURES):
    """Logistic control on whether a candidate is relevant, classes balanced."""
    totals = rows.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.5
    share = min(max(totals, 1e-6), 1 - 1e-6)
    weighed = rows.withColumn("target", (F.col("label") > 0).cast("double")).withColumn("weight", F.when(F.col("label") > 0, 0.5 / share).otherwise(0.5 / (1 - share)))
    steps = [_vector(columns), StandardScaler(inputCol="features_raw", outputCol="features", withMean=True), LogisticRegression(labelCol="target", weightCol="weight", maxIter=100, regParam=1e-3)]
    return Pipeline(stages=steps).fit(weighed)


def gain_trees(rows: DataFrame, columns=FEATURES, trees: int = 20, depth: int = 5):
    """Boosted trees on the gain ``2 ** label - 1``."""
    steps = [_vector(columns), GBTRegressor(featuresCol="features_raw", labelCol="gain", maxIter=trees, maxDepth=depth, seed=42, checkpointInterval=-1)]
    return Pipeline(stages=steps).fit(rows.withColumn("gain", F.pow(F.lit(2.0), "label") - 1))


def drawn(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``rows (user_id, product_id, label)`` with each candidate's ``place`` in its list by label, and its ``draw`` among those of its label in a hash's order."""
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("label"), "product_id")))
    return placed.withColumn("draw", F.row_number().over(W.partitionBy("user_id", "label").orderBy(shuffle_key(seed, "user_id", "product_id"))))


def pairwise_rows(rows: DataFrame, columns=FEATURES, each: int = 10, seed: int = 42) -> DataFrame:
    """Differences of a better and a worse candidate of a list, weighted by what a swap would cost in NDCG.

    A better candidate meets ``each`` of the worse ones, in a hash's order.  Rows that have their ``place`` and ``draw`` (:func:`drawn`) already
    are read without an exchange, and only those that are in a pair are exchanged.
    """
    placed = rows if {"place", "draw"} <= set(rows.columns) else drawn(rows, seed)
    kept = placed.filter((F.col("label") > 0) | (F.col("draw") <= each)).select("user_id", "product_id", "label", "place", "draw", *columns)
    a, b = kept.filter("label > 0").alias("a"), kept.filter(F.col("draw") <= each).alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.label") > F.col("b.label")))
    cost = F.abs((F.pow(F.lit(2.0), F.col("a.label")) - F.pow(F.lit(2.0), F.col("b.label"))) * (1 / F.log2(F.col("a.place") + 1) - 1 / F.log2(F.col("b.place") + 1)))
    # half of the pairs are turned round, so that both outcomes occur
    sign = F.when(stable_bucket(F.concat_ws(":", F.col("a.user_id").cast("string"), F.col("a.product_id").cast("string"), F.col("b.product_id").cast("string")), 2) == 0, 1.0).otherwise(-1.0)
    return met.select(F.col("a.user_id").alias("user_id"), *[(sign * (F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in columns], ((sign + 1) / 2).alias("target"), F.greatest(cost, F.lit(1e-3)).alias("weight"))


def pairwise(rows: DataFrame, columns=FEATURES):
    """Pairwise linear ranker: logistic regression without offset on differences."""
    steps = [_vector(columns), StandardScaler(inputCol="features_raw", outputCol="features", withMean=False), LogisticRegression(labelCol="target", weightCol="weight", fitIntercept=False, maxIter=100, regParam=1e-3)]
    return Pipeline(stages=steps).fit(pairwise_rows(rows, columns))


def linear_score(model) -> Column:
    """The linear decision of a fitted pipeline."""
    if any(isinstance(s, type(model.stages[-1])) for s in model.stages) and hasattr(model.stages[-1], "coefficients"):
        return F.element_at(vector_to_array(F.col("rawPrediction")), 2)
    return F.col("prediction")


def score_pool(model, rows: DataFrame, keep: int = 40) -> DataFrame:
    """Scores of a pool, 0 to 1 in each list, the ``keep`` best."""
    scored = model.transform(rows).select("user_id", "product_id", linear_score(model).alias("score"))
    return top_k(scored.withColumn("score", minmax_within(F.col("score"), ["user_id"])), ["user_id"], "score", "product_id", keep)


def importances(model, spark, columns=FEATURES) -> DataFrame:
    """Each feature's share of the model's gain (or of its absolute coefficients)."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(values.sum()) or 1.0
    return spark.createDataFrame([(c, float(v), float(v) / total) for c, v in zip(columns, values, strict=True)], "feature string, importance double, share double").orderBy(F.desc("share"), "feature")


def attributions(model, rows: DataFrame, columns=FEATURES, keep: int = 5) -> DataFrame:
    """The features that move each linear score most: coefficient times scaled value."""
    last = model.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in last.coefficients.toArray()])
    scaled = model.transform(rows).select("user_id", "product_id", F.zip_with(vector_to_array(F.col("features")), weights, lambda x, w: x * w).alias("parts"))
    # a row's effects are ranked within the row: the largest first, equal ones by name
    by_name = {c: i for i, c in enumerate(sorted(columns))}
    facts = F.array(*[F.struct(F.lit(-by_name[c]).alias("place"), F.lit(c).alias("feature")) for c in columns])
    entries = F.zip_with("parts", facts, lambda x, f: F.struct(F.abs(x).alias("size"), f["place"].alias("place"), f["feature"].alias("feature"), x.alias("effect")))
    opened = scaled.select("user_id", "product_id", F.posexplode(F.slice(F.sort_array(entries, asc=False), 1, keep)).alias("at", "e"))
    return opened.select("user_id", "product_id", F.col("e.feature").alias("feature"), F.col("e.effect").alias("effect"), (F.col("at") + 1).alias("rank"))
