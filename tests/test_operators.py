"""Hand-made cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrec.operators import analytics, counters, drift, evaluation, rerank, significance, split, validation, weighting

NOW = datetime(2024, 3, 1)
ROWS = "user_id long, product_id long, event_type string, occurred_at timestamp"


def interactions(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_recency_halves_weight(spark):
    rows = interactions(spark, [(1, 1, "PRODUCT_VIEW", NOW), (1, 2, "PRODUCT_VIEW", NOW - timedelta(days=45))])
    got = {r.product_id: r.weight for r in weighting.interaction_matrix(rows, {"PRODUCT_VIEW": 1.0}, F.lit(NOW)).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.5})


def test_weight_is_capped_and_negative_pairs_go(spark):
    rows = interactions(spark, [(1, 1, "PURCHASE", NOW)] * 500 + [(1, 2, "REMOVE_FROM_CART", NOW)])
    got = weighting.interaction_matrix(rows, {"PURCHASE": 10.0, "REMOVE_FROM_CART": -1.0}, F.lit(NOW)).collect()
    assert [(r.product_id, r.weight) for r in got] == [(1, 60.0)]


def test_calibration_falls_back_to_priors():
    assert weighting.derive({}, 0.0)["PURCHASE"]["weight"] == 10.0


def test_calibration_orders_the_funnel():
    got = weighting.derive({"PRODUCT_VIEW": (1000, 0.1), "PRODUCT_CLICK": (500, 0.3), "ADD_TO_CART": (300, 0.6), "PURCHASE": (250, 1.0)}, 0.08)
    assert got["PRODUCT_VIEW"]["weight"] == 1.0 < got["PRODUCT_CLICK"]["weight"] < got["ADD_TO_CART"]["weight"] < got["PURCHASE"]["weight"]


def test_split_guards(spark):
    rows = interactions(spark, [(1, i, "PRODUCT_VIEW", NOW + timedelta(hours=i)) for i in range(100)])
    folds = split.split_temporal(rows)
    split.assert_no_leakage(folds)
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == {"train": 69, "validation": 15, "test": 16}
    with pytest.raises(ValueError):
        split.assert_no_leakage(folds.withColumn("fold", F.when(F.col("product_id") % 2 == 0, "train").otherwise(F.col("fold"))))
    with pytest.raises(ValueError):
        split.assert_before(rows, F.lit(NOW + timedelta(hours=5)))
    with pytest.raises(ValueError):
        split.split_temporal(rows.limit(0))


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([("m", 1, p, r) for r, p in enumerate([10, 20, 30], 1)], "model string, user_id long, product_id long, rank int")
    wanted = spark.createDataFrame([(1, 20), (1, 99), (2, 5)], "user_id long, product_id long")
    got = {r.user_id: r for r in evaluation.accuracy(recs, wanted, 3).collect()}
    one = got[1]
    assert one.precision == pytest.approx(1 / 3) and one.recall == 0.5 and one.map == pytest.approx(0.25) and one.mrr == 0.5
    assert one.ndcg == pytest.approx(0.63092975 / 1.63092975, abs=1e-6)
    assert got[2].ndcg == 0 and got[2].hit == 0


def test_gini_bounds(spark):
    even = spark.createDataFrame([(i, 5) for i in range(10)], "id int, n int")
    assert evaluation.gini(even, []).first()[0] == pytest.approx(0)
    skew = spark.createDataFrame([(i, 0) for i in range(99)] + [(99, 100)], "id int, n int")
    assert evaluation.gini(skew, []).first()[0] > 0.98


def test_two_proportions(spark):
    df = spark.createDataFrame([(500, 10_000, 650, 10_000), (500, 10_000, 510, 10_000), (0, 0, 0, 0)], "x1 int, n1 int, x2 int, n2 int")
    got = [r.significant for r in significance.two_proportions(df).orderBy(F.desc("x2")).collect()]
    assert got == [True, False, False]


def test_sample_ratio(spark):
    arms = lambda a, b: spark.createDataFrame([("a", a, 0.5), ("b", b, 0.5)], "variant string, n long, expected_share double")
    assert not significance.sample_ratio(arms(4980, 5020)).first().mismatch
    assert significance.sample_ratio(arms(6500, 3500)).first().mismatch
    assert significance.sample_ratio(arms(0, 0)).first().p_value == 1.0


def test_drift_alerts_and_vanished_category(spark):
    a = spark.range(5000).select(F.lit("x").alias("feature"), F.randn(1).alias("value"))
    b = spark.range(5000).select(F.lit("x").alias("feature"), (F.randn(2) + 2.5).alias("value"))
    assert drift.psi_numeric(a, b).first().severity == "alert" and drift.ks(a, b).first().ks > 0.5
    one = spark.createDataFrame([("c", "a"), ("c", "b")], "feature string, value string")
    assert 0 < drift.psi_categorical(one, one.filter("value = 'a'")).first().psi < 100


def test_gate_rejects_coverage_collapse(spark):
    of = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    base = {"ndcg": 0.06, "recall": 0.07, "coverage": 0.3}
    first = lambda c, i: drift.gate(c, i).first().outcome
    assert first(of(**base), of(**base)) == "promote"
    assert first(of(**(base | {"coverage": 0.1})), of(**base)) == "reject"
    assert first(of(**base), of(ndcg=0.0).limit(0)) == "promote_first"


def test_event_rules(spark):
    rows = [
        (1, NOW, "PRODUCT_VIEW", "session-1", 5, "web", '{"dwell_ms": 10}'), (2, NOW, "PRODUCT_VIEW", "session-1", 5, "web", '{"color": "red"}'),
        (3, NOW, "SEARCH", "session-1", None, "web", "{}"), (4, NOW, "SEARCH", "session-1", 5, "web", '{"query": "hat"}'),
        (5, NOW - timedelta(days=8), "PURCHASE", "session-1", 5, "web", None), (6, NOW + timedelta(hours=1), "PURCHASE", "session-1", 5, "web", '{"quantity": 1000}'),
        (7, None, "PRODUCT_RATING", "short", 5, "web", '{"rating": 4.5}'), (8, NOW, "NOVEL", "session-1", 5, "web", None), (9, NOW, "PURCHASE", "session-1", 0, "web", "oops"),
    ]
    df = spark.createDataFrame(rows, "event_id long, occurred_at timestamp, event_type string, session_key string, product_id long, source string, event_metadata string")
    got = {r.event_id: r for r in validation.validate(df, F.lit(NOW)).collect()}
    assert {k: sorted(r.reasons) for k, r in got.items()} == {1: [], 2: ["unknown_key"], 3: ["missing_query"], 4: ["needless_product"], 5: ["too_old"], 6: ["bad_quantity"], 7: ["bad_session_key"], 8: ["unknown_type"], 9: ["bad_payload", "bad_product_id"]}
    assert got[6].occurred_at == NOW and got[7].occurred_at == NOW and got[5].payload == {"quantity": "1"}


def test_sessions_merge_like_one_batch(spark):
    rows = [(1, "s", None, "unknown", "PRODUCT_VIEW", NOW), (2, "s", 7, "mobile", "PRODUCT_VIEW", NOW - timedelta(hours=1)), (3, "s", None, "desktop", "PURCHASE", NOW + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "event_id long, session_key string, user_id long, device_type string, event_type string, occurred_at timestamp")
    whole = counters.roll_up_sessions(df).first()
    a, b = counters.roll_up_sessions(df.filter("event_id < 3")), counters.roll_up_sessions(df.filter("event_id = 3"))
    assert counters.merge_sessions(a, b).first() == whole == ("s", 7, "mobile", NOW - timedelta(hours=1), NOW + timedelta(hours=1), 3, True)


def test_recent_moves_to_front(spark):
    rows = [(i, 1, p, "PRODUCT_VIEW", NOW + timedelta(minutes=i)) for i, p in enumerate([10, 20, 10])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, product_id long, event_type string, occurred_at timestamp")
    assert [r.product_id for r in counters.recently_viewed(df).orderBy("rank").collect()] == [10, 20]


def test_diversity_keeps_caps_then_fills(spark):
    rows = [(1, i, 1 - i / 100, "c1" if i < 8 else "c2", f"b{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "user_id long, product_id long, score double, category_id string, brand_id string")
    got = [r.product_id for r in rerank.diversify(df, 8).orderBy("rank").collect()]
    assert len(got) == 8 and sum(p < 8 for p in got) == 4
    assert len(rerank.diversify(df.filter("category_id = 'c1'"), 8).collect()) == 8


def test_revenue_is_not_multiplied(spark):
    served = spark.createDataFrame([(1, 9)], "recommendation_id long, user_id long").withColumn("surface", F.lit("home"))
    clicks = spark.createDataFrame([(1,)] * 3, "recommendation_id long")
    sold = spark.createDataFrame([(1, 50.0)], "recommendation_id long, revenue double")
    row = analytics.funnel(analytics.outcomes(served, clicks, sold), "surface").first()
    assert (row.impressions, row.clicks, row.conversions, row.revenue, row.cvr) == (1, 3, 1, 50.0, pytest.approx(0.333333))


def test_attribution_takes_the_last_click_in_the_window(spark):
    kinds = "event_id long, user_id long, product_id long, occurred_at timestamp"
    clicks = spark.createDataFrame([(1, 1, 5, NOW - timedelta(hours=200)), (2, 1, 5, NOW - timedelta(hours=3)), (3, 1, 5, NOW + timedelta(hours=1))], kinds)
    sold = spark.createDataFrame([(10, 1, 5, NOW), (11, 1, 5, NOW - timedelta(hours=10)), (12, 2, 5, NOW)], kinds)
    assert {r.purchase_id: r.click_id for r in analytics.attribute(sold, clicks).collect()} == {10: 2, 11: None, 12: None}


@pytest.mark.parametrize("arms", [2, 3, 5])
def test_sample_ratio_of_several_arms(spark, arms):
    """Against the tail of simulated multinomial draws, and the value known for three arms."""
    import numpy as np

    rng = np.random.default_rng(arms)
    seen = [1060, 1000, 950, 1010, 990][:arms]
    rows = spark.createDataFrame([(f"a{i}", n, 1 / arms) for i, n in enumerate(seen)], "variant string, n long, expected_share double")
    got = significance.sample_ratio(rows).first()
    drawn = rng.multinomial(sum(seen), [1 / arms] * arms, 200_000)
    simulated = (((drawn - sum(seen) / arms) ** 2 / (sum(seen) / arms)).sum(1) >= got.chi_square - 1e-9).mean()
    assert got.p_value == pytest.approx(simulated, abs=0.012)
    if arms == 3:
        assert got.p_value == pytest.approx(0.0486, abs=1e-3)


def test_poisson_draws(spark):
    import numpy as np
    from tallyrec.functions.columns import poisson_draw

    for mean in (1.0, 3.0, 40.0, 500.0):
        u = (F.pmod(F.xxhash64("id"), F.lit(2**40)) + 0.5) / F.lit(2.0**40)
        got = np.array([r[0] for r in spark.range(40_000).select(poisson_draw(u, F.lit(mean))).collect()])
        assert got.mean() == pytest.approx(mean, rel=0.02) and got.var() == pytest.approx(mean, rel=0.05) and (got == np.round(got)).all()


def test_paired_bootstrap_is_near_a_plain_one(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    d = np.where(rng.random(2000) < 0.2, rng.normal(0.025, 0.15, 2000), 0.0)
    rows = [(m, int(u), float(x)) for u, x in enumerate(d) for m, x in (("a", 0.0), ("b", x))]
    got = significance.paired_bootstrap(spark.createDataFrame(rows, "model string, user_id long, ndcg double"), "a", "b").first()
    means = np.array([rng.choice(d, 2000).mean() for _ in range(5000)])
    low, high = np.percentile(means, [2.5, 97.5])
    assert got.difference == pytest.approx(d.mean(), abs=1e-6) and got.users == 2000
    assert got.low == pytest.approx(low, abs=0.0006) and got.high == pytest.approx(high, abs=0.0006)
    assert got.p_value == pytest.approx(min(1, 2 * min((means <= 0).mean(), (means >= 0).mean())), abs=0.02)


def test_mean_bootstrap_of_skewed_values(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.exponential(10, 600) * (rng.random(600) < 0.1)
    got = significance.mean_bootstrap(spark.createDataFrame([("a", float(v)) for v in x], "arm string, revenue double"), "arm", "revenue").first()
    low, high = np.percentile([rng.choice(x, 600).mean() for _ in range(4000)], [2.5, 97.5])
    assert got["mean"] == pytest.approx(x.mean()) and got.users == 600
    assert got.low == pytest.approx(low, abs=0.06) and got.high == pytest.approx(high, abs=0.06)


def slow_diversify(rows, k, relevance=0.72, per_category=4, per_brand=3):
    left, out = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left and len(out) < k:
        fits = [r for r in left if sum(o[2] == r[2] for o in out) < per_category and sum(o[3] == r[3] for o in out) < per_brand]
        value = lambda r: relevance * r[1] - (1 - relevance) * (sum(o[2] == r[2] for o in out) / len(out) if out else 0)
        best = max(fits, key=value) if fits else left[0]
        left.remove(best)
        out.append(best)
    return [r[0] for r in out]


def test_diversify_sees_the_whole_list(spark):
    import random

    rng = random.Random(1)
    lists = {1: [(p, 1 - p / 1000, "one" if p < 60 else f"c{p % 5}", f"b{p % 9}") for p in range(200)], 2: [(p, round(rng.random(), 3), f"c{rng.randrange(3)}", f"b{rng.randrange(3)}") for p in range(150)], 3: [(1, 0.5, "c", "b")], 4: [(p, 0.5, None, None) for p in range(9)]}
    rows = spark.createDataFrame([(u, *r) for u, of in lists.items() for r in of], "user_id long, product_id long, score double, category_id string, brand_id string")
    got = {}
    for r in sorted(rerank.diversify(rows, 10).collect(), key=lambda r: (r.user_id, r.rank)):
        got.setdefault(r.user_id, []).append(r.product_id)
    assert got == {u: slow_diversify(of, 10) for u, of in lists.items()}


def test_content_lists_are_full_however_much_was_seen(spark):
    from tallyrec.operators import content

    import numpy as np

    rng = np.random.default_rng(2)
    items, users = rng.normal(size=(400, 6)), rng.normal(size=(7, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "product_id long, vector array<double>")
    tastes = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_id long, vector array<double>")
    order = np.argsort(-(users @ items.T), axis=1, kind="stable")
    seen = spark.createDataFrame([(u, int(p)) for u in range(7) for p in order[u, : 55 * u]] + [(99, 1)], "user_id long, product_id long")
    got = {}
    for r in sorted(content.recommend(tastes, vectors, seen, 10, block=50).collect(), key=lambda r: (r.user_id, r["rank"])):
        got.setdefault(r.user_id, []).append(r.product_id)
    assert got == {u: order[u, 55 * u : 55 * u + 10].tolist() for u in range(7)}


def test_large_baskets_are_paired_block_by_block(spark, monkeypatch):
    from tallyrec.operators import cooccurrence

    monkeypatch.setattr(cooccurrence, "BLOCK", 4)
    rows = [(b, p) for b in range(6) for p in range(0, 30, b + 1)]
    baskets = spark.createDataFrame(rows, "order_id long, product_id long")
    got = {(r["item"], r.neighbour): r.support for r in cooccurrence.bought_together(baskets, k=100).collect()}
    of = {b: {p for c, p in rows if c == b} for b in range(6)}
    want = {(x, y): sum({x, y} <= s for s in of.values()) for x in range(30) for y in range(30) if x != y}
    assert got == {pair: n for pair, n in want.items() if n >= 2}


def test_times_at_positions(spark):
    import random

    rng = random.Random(3)
    times = sorted(NOW + timedelta(microseconds=rng.choice((1, 3_700_000_000, 500_000)) * rng.randrange(40)) for _ in range(500))
    rows = spark.createDataFrame([(1, 1, "PURCHASE", t) for t in times], ROWS)
    fractions = [0.0, 0.1, 0.5, 0.7, 0.85, 1.0]
    micros = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert split.time_at(rows, fractions) == [micros(times[round(499 * q)]) for q in fractions]


def test_dense_index_of_any_ids(spark):
    from tallyrec.operators import collaborative

    ids = [f"p{i * 37 % 1000:04d}" for i in range(1000)] * 2
    got = {r["product_id"]: r["i"] for r in collaborative.dense_index(spark.createDataFrame([(x,) for x in ids], "product_id string").repartition(7), "product_id", "i").collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(ids)))}


def test_factors_of_ids_of_any_kind(spark):
    from tallyrec.operators import collaborative

    cells = [(u, p, 1.0 + (u * p) % 5) for u in range(20) for p in range(12) if (u + p) % 3]
    for shift in (0, 2**40):
        weights = spark.createDataFrame([(u + shift, p, w) for u, p, w in cells], "user_id long, product_id long, weight double")
        found = collaborative.fit(weights, factors=4, rounds=3)
        assert {r.user_id for r in found.users.collect()} == {u + shift for u in range(20)}
        assert {r.product_id for r in found.items.collect()} == set(range(12)) and {len(r.vector) for r in found.items.collect()} == {4}


def test_more_rounds_lower_the_factor_models_objective(spark):
    """Confidence-weighted squares and the ridge, each user's and item's weighed by its number of ratings."""
    import numpy as np
    from tallyrec.operators import collaborative

    rng = np.random.default_rng(3)
    w = np.where(rng.random((30, 20)) < 0.3, rng.uniform(0.5, 5, (30, 20)), 0.0)
    cells = [(u, i, float(w[u, i])) for u, i in zip(*np.nonzero(w))]
    weights = spark.createDataFrame([(int(u), int(i), x) for u, i, x in cells], "user_id long, product_id long, weight double")

    def objective(rounds):
        f = collaborative.fit(weights, factors=5, rounds=rounds)
        x, y = np.zeros((30, 5)), np.zeros((20, 5))
        for r in f.users.collect():
            x[r.user_id] = r.vector
        for r in f.items.collect():
            y[r.product_id] = r.vector
        n_u, n_i = (w > 0).sum(1), (w > 0).sum(0)
        return ((1 + 2.0 * w) * ((w > 0) - x @ y.T) ** 2).sum() + 0.1 * ((n_u[:, None] * x**2).sum() + (n_i[:, None] * y**2).sum())

    first, later = objective(1), objective(10)
    assert later < 0.98 * first


def test_reduced_rows_keep_what_a_plain_svd_keeps(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from tallyrec.operators import content

    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 12)) < 0.4, rng.uniform(0, 1, (40, 12)), 0.0)
    rows = spark.createDataFrame([(i, Vectors.sparse(12, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)], ["product_id", "vector"])
    reduced, kept = content.reduce_rank(rows, 4)
    got = np.array([r.vector for r in reduced.orderBy("product_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    plain = u[:, :4] * s[:4]
    assert np.allclose(got @ got.T, plain @ plain.T, atol=1e-6) and abs(kept - (s[:4] ** 2).sum() / (s**2).sum()) < 1e-6
