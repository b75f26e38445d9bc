"""Whole jobs: train and evaluate on a data set, and retrain behind the drift check and the gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.operators import candidates, collaborative, cooccurrence, drift, evaluation, features, popularity, quality, split, weighting
from tallyrec.sources.adapters import last_moment
from tallyrec.sources.io import Dataset, fingerprint, write_artefacts

#: Features that the drift check watches.
USER_WATCH = ["total_events", "total_purchases", "avg_purchase_price", "price_percentile_mean", "view_to_purchase_rate", "category_concentration", "days_since_last_event"]


def train(spark: SparkSession, data: Dataset, folder: str, run_id: str, *, als: dict | None = None, k: int = 20, primary_k: int = 10) -> DataFrame:
    """Split, weigh, build features and models on the train fold, evaluate on the test fold, write everything.

    Returns ``metric, value`` of the best model.  Tables that several later steps read are
    written once and read back.
    """
    rows = data.interactions()
    failed = quality.training_contract(rows, data.products).filter("not passed").collect()
    if failed:
        raise ValueError(f"the data doesn't meet the contract: {[r['check'] for r in failed]}")
    folds = split.split_temporal(rows)
    write_artefacts({"folds": folds}, folder, run_id)
    folds = spark.read.parquet(f"{folder}/{run_id}/folds")
    split.assert_no_leakage(folds)
    past = folds.filter("fold = 'train'").drop("fold")
    cut = folds.filter("fold <> 'train'").agg(F.unix_micros(F.min("occurred_at"))).first()[0]
    as_of = F.timestamp_micros(F.lit(cut).cast("long"))

    found = weighting.calibrate(past)
    weights = weighting.interaction_matrix(past, {t: x["weight"] for t, x in found.items()}, as_of)
    write_artefacts({"calibration": weighting.report(spark, found), "weights": weights, "fingerprint": fingerprint(folds)}, folder, run_id)
    weights = spark.read.parquet(f"{folder}/{run_id}/weights")

    tables = {
        "user_features": features.user_features(past, data.products, as_of, data.orders),
        "product_features": features.product_features(past, data.products, as_of),
        "category_affinity": features.affinity(past, weights, data.products, "category_id", 10),
        "brand_affinity": features.affinity(past, weights, data.products, "brand_id", 6),
        "popular": popularity.popular(weights),
        "popular_by_category": popularity.popular_by_category(weights, data.products),
        "trending": popularity.trending(past, as_of),
        "covisited": cooccurrence.covisited(past),
    }
    factors = collaborative.fit(collaborative.supported(weights), **(als or {}))
    tables |= {"user_factors": factors.users, "item_factors": factors.items}
    write_artefacts(tables, folder, run_id)
    read = lambda name: spark.read.parquet(f"{folder}/{run_id}/{name}")

    users = folds.filter("fold = 'test'").select("user_id").distinct()
    seen = past.select("user_id", "product_id").distinct()
    stored = collaborative.Factors(read("user_factors"), read("item_factors"))
    known = stored.users.join(users, "user_id", "left_semi")
    lists = {
        "popular": popularity.recommend(read("category_affinity"), read("popular_by_category"), read("popular"), seen, users, k),
        "trending": candidates.static_source(read("trending"), users, seen, k).withColumn("rank", F.col("rank") + 1),
        "covisitation": cooccurrence.recommend(candidates.contexts(past), read("covisited"), seen, k),
        "collaborative": collaborative.recommend(known, stored, seen, k),
    }
    recs = None
    for name, df in lists.items():
        one = df.select(F.lit(name).alias("model"), "user_id", "product_id", "rank")
        recs = one if recs is None else recs.unionByName(one)
    write_artefacts({"recommendations": recs}, folder, run_id)
    recs = read("recommendations")
    targets = evaluation.graded_targets(folds, "test")
    scored = evaluation.means(evaluation.accuracy(recs, targets, primary_k), evaluation.segments(past, targets))
    catalogue = data.products.count()
    beyond = evaluation.coverage(recs, catalogue).join(evaluation.intra_list_diversity(recs, data.products), "model").join(evaluation.novelty(recs, past), "model")
    write_artefacts({"evaluation": evaluation.comparison(scored).join(beyond, "model"), "evaluation_by_segment": scored}, folder, run_id)
    best = read("evaluation").orderBy(F.desc("ndcg"), "model").limit(1)
    named = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("ndcg", "recall", "coverage", "diversity", "novelty")]
    metrics = best.select(F.explode(F.array(*named)).alias("m")).select("m.*")
    write_artefacts({"metrics": metrics}, folder, run_id)
    return read("metrics")


def check_drift(data: Dataset, at: datetime, days: int = 14) -> DataFrame:
    """Watched features of the window that ends at ``at`` against the window before it."""
    rows = data.interactions()
    end, middle, begin = F.lit(at), F.lit(at) - F.expr(f"interval {days} days"), F.lit(at) - F.expr(f"interval {2 * days} days")
    of = lambda a, b: features.user_features(rows.filter((F.col("occurred_at") >= a) & (F.col("occurred_at") < b)), data.products, b)
    return drift.compare(of(begin, middle), of(middle, end), USER_WATCH)


def current_run(spark: SparkSession, folder: str) -> str | None:
    """The run that is published, if any: the newest row of a one-row table for each publication."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/current").orderBy(F.desc("published_at")).first()["run_id"]


def publish(spark: SparkSession, folder: str, run_id: str, outcome: str) -> None:
    row = spark.createDataFrame([(run_id, outcome)], "run_id string, outcome string").withColumn("published_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{folder}/{'rejected' if outcome == 'reject' else 'current'}")


def retrain(spark: SparkSession, data: Dataset, folder: str, run_id: str, *, force: bool = False, at: datetime | None = None, **options) -> str:
    """Train if the data has drifted (or ``force``), and publish the run only if the gate lets it pass.

    ``options`` go to :func:`train`.  Returns ``skipped``, ``reject``, ``promote`` or ``promote_first``.  Without a published run it trains.
    """
    incumbent = current_run(spark, folder)
    if incumbent and not force:
        moment = at or spark.range(1).select(last_moment(data.events)).first()[0]
        if not drift.should_retrain(check_drift(data, moment)).first()["retrain"]:
            return "skipped"
    metrics = train(spark, data, folder, run_id, **options)
    old = spark.read.parquet(f"{folder}/{incumbent}/metrics") if incumbent else metrics.limit(0)
    outcome = drift.gate(metrics, old).first()["outcome"]
    publish(spark, folder, run_id, outcome)
    return outcome
