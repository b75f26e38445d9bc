"""Trees from binned sums against plain splits and Spark's own boosting."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import listwise, ranking, trees

COLUMNS = ("a", "b", "c")


def test_edges_keep_rare_values_and_rows_take_a_byte_a_feature(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=4000), (rng.random(4000) < 0.002) * 7.0, rng.integers(0, 5, 4000)], axis=1)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    edges = trees.edges_of(rows, 3)
    assert len(edges[0]) == trees.BINS - 1 and edges[1].tolist() == [0.0] and edges[2].tolist() == [0.0, 1.0, 2.0, 3.0]
    got = {r.id: list(r.bins) for r in trees.binned(rows, edges).collect()}
    want = trees.in_bins(x, edges)
    assert all(got[i] == want[:, i].tolist() for i in range(4000))
    share = np.bincount(want[0], minlength=trees.BINS) / 4000
    assert share[1:-1].min() > 0.01 and share.max() < 0.025  # the first is the least value by itself


def test_a_tree_takes_the_best_splits(spark):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 6, (3, 400)).astype(np.uint8)
    pull, weight = rng.normal(size=400) + (bins[1] > 3) * (bins[2] < 2) * 3.0, rng.random(400) + 0.1
    edges = [np.arange(5.0)] * 3
    tree = trees.grow(lambda t, slot, n: trees.node_sums(bins, pull, weight, t, slot, n), edges, depth=2, least_rows=10, features_share=1.0, rate=0.5, shrink=1.0, seed=1)

    def best(rows):
        score = lambda r: pull[r].sum() ** 2 / weight[r].sum()
        found = []
        for f, at in itertools.product(range(3), range(5)):
            left, right = rows[bins[f, rows] <= at], rows[bins[f, rows] > at]
            if min(len(left), len(right)) >= 10:
                found.append((score(left) + score(right) - score(rows), f, at, left, right))
        return max(found, key=lambda x: x[0])

    gain, f, at, left, right = best(np.arange(400))
    assert (tree.feature[0], tree.bin[0]) == (f, at) and tree.gain[0] == pytest.approx(gain)
    leaf = tree.leaf_of(bins)
    for side in (left, right):
        _, _, _, a, b = best(side)
        for rows in (a, b):
            assert len(set(leaf[rows])) == 1 and tree.value[leaf[rows[0]]] == pytest.approx(0.5 * pull[rows].sum() / (weight[rows].sum() + 1))
    assert np.array_equal(tree.predict(bins.T.astype(float)), tree.value[leaf])


def test_gain_trees_are_as_good_as_sparks(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 3000))
    labels = np.clip(np.round(a + 0.7 * b * (c > 0) + 1), 0, 3).astype(int)
    rows = spark.createDataFrame([(int(i % 100), int(i), int(labels[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(3000)], "user_id long, product_id long, label int, a double, b double, c double")
    error = lambda m: m.transform(rows).agg(F.avg(F.pow(F.col("prediction") - (F.pow(F.lit(2.0), "label") - 1), 2))).first()[0]
    own, theirs = listwise.gain_trees(rows, COLUMNS, trees=12, depth=4), ranking.gain_trees(rows, COLUMNS, trees=12, depth=4)
    assert len(own.trees) == 12 and error(own) < 1.05 * error(theirs)
    assert listwise.gain_trees(rows.limit(0), COLUMNS).trees == []


def test_sums_do_not_depend_on_pieces_and_tasks(spark, monkeypatch):
    """Lists stay whole however rows are dealt into pieces; many tasks are added by tasks first."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(u, p, int(rng.integers(0, 4)), *map(float, rng.normal(size=3))) for u in range(40) for p in range(12)], "user_id long, product_id long, label int, a double, b double, c double")
    fitted = lambda: listwise.fit(rows.withColumn("part", F.when(F.col("user_id") < 30, "fit").otherwise("stop")), COLUMNS, rounds=3, depth=3, least_rows=3, sampled=1.0, features_share=1.0)
    whole = fitted()
    monkeypatch.setattr(listwise, "DEALT", 20)
    monkeypatch.setattr(trees, "DIRECT", 5)
    many = fitted()
    scores = [[r.prediction for r in m.transform(rows).orderBy("user_id", "product_id").collect()] for m in (whole, many)]
    assert scores[0] == pytest.approx(scores[1]) and whole.history == pytest.approx(many.history) and len(whole.history) == 3


def test_negatives_are_drawn_from_the_bins(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(u, p, int(p < 3), *map(float, rng.normal(size=3))) for u in range(20) for p in range(30)], "user_id long, product_id long, label int, a double, b double, c double").withColumn("part", F.lit("fit"))
    a = listwise.fit(rows, COLUMNS, rounds=2, depth=2, least_rows=2, negatives=5)
    assert len(a.trees) == 2 and a.transform(rows).select("prediction").distinct().count() > 2
