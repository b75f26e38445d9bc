"""Hard negatives and personalisation over all users, against plain versions."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import evaluation, ranking


def test_hard_negatives_are_drawn_in_proportion(spark):
    """Inclusion rates against sequential drawing without replacement."""
    users, n, each = 4000, 8, 3
    rows = spark.range(users).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(n + 1))).alias("product_id")).withColumn("label", (F.col("product_id") == n + 1).cast("int")).withColumn("candidate_rank", F.col("product_id"))
    got = ranking.sample_negatives(rows, each, hard="candidate_rank")
    counts = {r.product_id: r["count"] / users for r in got.groupBy("product_id").count().collect()}
    assert counts[n + 1] == 1
    weights = [1 / (i + 1) for i in range(n)]
    want = Counter()
    for drawn in itertools.permutations(range(n), each):
        chance, left = 1.0, sum(weights)
        for i in drawn:
            chance, left = chance * weights[i] / left, left - weights[i]
        for i in drawn:
            want[i + 1] += chance
    for place in range(1, n + 1):
        assert counts[place] == pytest.approx(want[place], abs=0.03)
    assert got.groupBy("user_id").count().filter(F.col("count") != each + 1).count() == 0


def test_few_negatives_all_stay(spark):
    rows = spark.createDataFrame([(1, p, int(p == 2), p) for p in range(1, 5)], "user_id long, product_id long, label int, candidate_rank int")
    assert ranking.sample_negatives(rows, 10, hard="candidate_rank").count() == 4


def test_personalisation_of_all_users(spark):
    rng = np.random.default_rng(2)
    lists = {("a", u): rng.choice(30, 10, False).tolist() for u in range(300)} | {("b", u): rng.choice(12, 10, False).tolist() for u in range(300)} | {("same", u): list(range(10)) for u in range(50)} | {("one", 1): [1, 2, 3]}
    rows = spark.createDataFrame([(m, u, int(p), r) for (m, u), of in lists.items() for r, p in enumerate(of, 1)], "model string, user_id long, product_id long, rank int")
    df = evaluation.personalisation_of_all(rows)
    got = {r.model: r for r in df.collect()}
    assert got["same"].personalisation == pytest.approx(0) and got["one"].personalisation == 0
    for m in "ab":
        sets = [set(of) for (model, _), of in lists.items() if model == m]
        want = np.mean([1 - len(x & y) / len(x | y) for x, y in itertools.combinations(sets, 2)])
        assert abs(got[m].personalisation - want) <= 4 * got[m].standard_error and got[m].standard_error < 0.02
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_positives_of_one_slot_are_dealt_into_groups(spark, monkeypatch):
    from tallyrec.operators import collaborative

    rows = spark.createDataFrame([(u, (u * 7 + i) % 40, 1.0) for u in range(30) for i in range(5)], "user_id long, product_id long, weight double")
    found = lambda: {tuple(r) for r in collaborative.triples(rows).collect()}
    whole = found()
    monkeypatch.setattr(collaborative, "DRAWN", 10)
    assert found() == whole and len(whole) == 450
