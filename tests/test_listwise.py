"""Listwise boosting: lambdas against loops, early stop, and what it wins over the linear rankers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import listwise, ranking

COLUMNS = ("a", "b", "c")


def plain_lambdas(labels, scores, ids):
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    place = {i: p for p, i in enumerate(order)}
    gain = [2**x - 1 for x in labels]
    ideal = sum(g / math.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)))
    pull, weight = [0.0] * len(ids), [0.0] * len(ids)
    for i in range(len(ids)):
        for j in range(len(ids)):
            if labels[i] > labels[j] and ideal:
                change = abs((gain[i] - gain[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
                pull[i] += change * wrong
                pull[j] -= change * wrong
                weight[i] += change * wrong * (1 - wrong)
                weight[j] += change * wrong * (1 - wrong)
    return pull, weight


def test_lambdas_equal_loops():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            labels, scores, ids = rng.integers(0, 4, n), rng.normal(size=n).round(1), rng.permutation(n)
            got = listwise.lambdas(labels.astype(float), scores, ids)
            want = plain_lambdas(labels.tolist(), scores.tolist(), ids.tolist())
            assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_ndcg():
    labels, ids = np.array([3.0, 0.0, 1.0]), np.array([1, 2, 3])
    assert listwise.ndcg_of(labels, np.array([3.0, 1.0, 2.0]), ids) == 1
    assert listwise.ndcg_of(labels, np.zeros(3), ids) == pytest.approx((7 + 0.5) / (7 + 1 / math.log2(3)))
    assert listwise.ndcg_of(np.zeros(3), labels, ids) is None


def lists(spark, users=150, seed=3, noise=0.5):
    """What counts is whether two features agree in sign, which no linear score sees."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        a, b, c = rng.normal(size=(3, 20))
        worth = np.sign(a * b) * 2 + 0.5 * c + noise * rng.normal(size=20)
        for p in range(20):
            rows.append((u, p, int(np.clip(round(worth[p]), 0, 3)), float(a[p]), float(b[p]), float(c[p])))
    return spark.createDataFrame(rows, "user_id long, product_id long, label int, a double, b double, c double")


def test_beats_the_linear_rankers_on_held_out_lists(spark):
    rows, held = lists(spark), lists(spark, 60, seed=9)
    model = listwise.fit(rows, COLUMNS, rounds=12, rate=0.3, depth=3, least_rows=5)
    got = listwise.mean_ndcg(model.transform(held).select("user_id", "product_id", "label", F.col("prediction").alias("score")))
    others = []
    for fitted in (ranking.pointwise(rows, COLUMNS), ranking.pairwise(rows, COLUMNS)):
        others.append(listwise.mean_ndcg(fitted.transform(held).select("user_id", "product_id", "label", ranking.linear_score(fitted).alias("score"))))
    assert got > max(others) + 0.1 and got > 0.75
    shares = {r.feature: r.share for r in model.importances(spark).collect()}
    assert shares["a"] + shares["b"] > 0.5 and sum(shares.values()) == pytest.approx(1)


def test_stops_early_and_keeps_the_best_round(spark):
    """Labels without sense: the stop part's NDCG doesn't rise for long."""
    rows = lists(spark, 60).withColumn("label", F.pmod(F.xxhash64("user_id", "product_id"), F.lit(4)).cast("int"))
    model = listwise.fit(rows, COLUMNS, rounds=14, patience=3, rate=0.3, depth=3, least_rows=5)
    best = int(np.argmax(model.history))
    assert len(model.trees) == best + 1 and (len(model.history) == 14 or len(model.history) == best + 4)
    assert len(model.history) < 14


def test_scores_of_lists_do_not_depend_on_batches(spark):
    rows = lists(spark, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        few = listwise.fit(rows.withColumn("part", F.lit("fit")), COLUMNS, rounds=2, sampled=1.0, features_share=1.0, least_rows=1, depth=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = listwise.fit(rows.withColumn("part", F.lit("fit")), COLUMNS, rounds=2, sampled=1.0, features_share=1.0, least_rows=1, depth=2)
    a, b = ([r.prediction for r in m.transform(rows).orderBy("user_id", "product_id").collect()] for m in (few, many))
    assert a == pytest.approx(b) and len(set(a)) > 3


def test_lists_without_grades_give_no_trees(spark):
    model = listwise.fit(lists(spark, 5).withColumn("label", F.lit(0)), COLUMNS, rounds=3)
    assert model.trees == [] and model.transform(lists(spark, 2)).agg(F.sum("prediction")).first()[0] == 0
