"""What must not be sent whole to the driver, formed twice or cut, however small the test tables are."""

import re
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import asof, content, features, profiles, ranking
from tallyrec.plans.registry import Tables, load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def sent_tables(df):
    """How many tables the plan sends to every task."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_the_catalogue_is_not_sent_with_the_interactions(spark, tables):
    assert sent_tables(tables.rows) == 0
    assert sent_tables(asof.user_days(tables.rows, tables.products).select("user_id", "day")) <= 1  # the distinct prices
    assert sent_tables(features.affinity(tables.rows, tables.rows.select("user_id", "product_id", F.lit(1.0).alias("weight")), tables.products, "brand_id", 3)) == 0


def test_kept_interactions_are_the_same_rows(spark):
    plain, kept = Tables(spark, SF), Tables(spark, SF).keep()
    assert kept.keep().rows is kept.rows
    assert kept.rows.schema == plain.rows.schema
    assert kept.rows.exceptAll(plain.rows).count() == 0 and kept.rows.count() == plain.rows.count()
    assert "get_json_object" not in kept.rows._jdf.queryExecution().optimizedPlan().toString()


def test_features_at_days_read_the_events_once(spark, tables):
    found = asof.product_features_at(asof.product_days(tables.rows), tables.products, [19740, 19741])
    assert "events.parquet" not in "".join(found.inputFiles())
    assert load()["f16_product_features_asof"](spark, SF).count() == 10 * tables.products.count()


def test_overlaps_are_exact_beyond_a_sketch(spark):
    n = 40_000  # a sketch of 2 ** 14 entries only estimates so many
    at = lambda day: F.timestamp_seconds(F.lit(86_400 * day))
    early, late = spark.range(n).select(F.col("id").alias("user_id"), at(3).alias("occurred_at")), spark.range(n // 2, 2 * n).select(F.col("id").alias("user_id"), at(11).alias("occurred_at"))
    events = early.unionByName(early).unionByName(late).unionByName(late.limit(3).withColumn("user_id", F.lit(None).cast("long"))).withColumn("kind", F.lit("x"))
    (row,) = profiles.exact_overlap(profiles.daily_users(events, ["kind"]), (0, 6), (7, 13), ["kind"]).collect()
    assert (row.a_users, row.b_users, row.both, row.either) == (n, n * 3 // 2, n // 2, 2 * n)


def test_the_factor_of_close_values_is_exact(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = np.where(rng.random((600, 150)) < 0.05, 1.0, 0.0)  # values lie close together
    rows = spark.createDataFrame([(i, Vectors.sparse(150, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)], ["product_id", "vector"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    reduced, kept = content.reduce_rank(rows, 5)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 20
    got = np.array([r.vector for r in reduced.orderBy("product_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got @ got.T, (u[:, :5] * s[:5] ** 2) @ u[:, :5].T, atol=1e-4)
    assert kept == pytest.approx((s[:5] ** 2).sum() / (s**2).sum(), abs=1e-6)
    nothing, kept = content.reduce_rank(spark.createDataFrame([(1, Vectors.sparse(4, {}))], ["product_id", "vector"]), 2)
    assert [r.vector for r in nothing.collect()] == [[0.0, 0.0]] and kept == 0


def test_blocks_of_any_size_find_the_same(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-1, 2, (90, 6)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "product_id long, vector array<double>")
    size = np.linalg.norm(v, axis=1, keepdims=True)
    w = v / np.where(size > 0, size, 1)
    for block in (7, 40, 8000):
        found = {(r["item"], r["rank"]): (r.neighbour, r.score) for r in content.similar(vectors, 5, block=block).collect()}
        assert len(found) == 450
        for i in range(90):
            want = sorted(((-round(float(w[i] @ w[j]), 9), j) for j in range(90) if j != i))[:5]
            assert [round(found[i, r + 1][1], 9) for r in range(5)] == [-s for s, _ in want]


def test_texts_are_dealt_over_tasks(spark, tables):
    assert content.dealt_text(tables.products).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_effects_are_ranked_within_their_row(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(u, p, int(rng.random() < 0.4), *map(float, rng.integers(-2, 3, 3))) for u in range(12) for p in range(5)], "user_id long, product_id long, label int, b double, a double, c double")
    model = ranking.pointwise(rows, ("b", "a", "c"))
    found = ranking.attributions(model, rows, ("b", "a", "c"), keep=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    scaled = {(r.user_id, r.product_id): r.v for r in model.transform(rows).select("user_id", "product_id", content.vector_to_array("features").alias("v")).collect()}
    w = model.stages[-1].coefficients.toArray()
    got = {(r.user_id, r.product_id, r["rank"]): (r.feature, r.effect) for r in found.collect()}
    assert len(got) == 120
    for (u, p), v in scaled.items():
        want = sorted(((-abs(x * y), n, x * y) for x, y, n in zip(v, w, "bac", strict=True)))[:2]
        assert [got[u, p, i + 1] for i in range(2)] == [(n, pytest.approx(e)) for _, n, e in want]


def test_tasks_of_pairs_grow_in_number(spark, monkeypatch):
    """Rows of an exchange over the session's fixed number of tasks grow with the input (g25_bought_together, g26_bought_for_users, j9_similar_or)."""
    from tallyrec.operators import cooccurrence

    items = spark.createDataFrame([(o, (o * k) % 17) for o in range(90) for k in (1, 2, 3)], "order_id long, product_id long")
    plain = sorted(map(tuple, cooccurrence.bought_together(items).collect()))
    monkeypatch.setattr(cooccurrence, "DEALT", 10)
    dealt = cooccurrence.bought_together(items)
    assert sorted(map(tuple, dealt.collect())) == plain
    numbers = [int(n) for n in re.findall(r"hashpartitioning\(x#\d+L?, y#\d+L?, (\d+)\)", dealt._jdf.queryExecution().executedPlan().toString())]
    assert numbers and min(numbers) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_unit_sums_a_vector_once(spark):
    import time

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda x: x.cast("double")).alias("v"))
    start = time.monotonic()
    size = rows.select(content.unit(F.col("v")).alias("v")).select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).first()["n"]
    assert abs(size - 1) < 1e-9
    # 30,000 sums of 30,000 values would take minutes
    assert time.monotonic() - start < 30
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0]), (4, [])], "id long, v array<double>")
    assert {r.id: r.u for r in odd.select("id", content.unit(F.col("v")).alias("u")).collect()} == {1: [0.0, 0.0], 2: None, 3: [0.6, 0.8], 4: []}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_vectors_dont_pass_through_python(spark):
    texts = spark.createDataFrame([(1, "red chair"), (2, "red chair and table"), (3, None), (4, "red red table")], "product_id long, text string").fillna("")
    assert "Python" not in _plan(content.tfidf(texts)(texts))


def test_taste_doesnt_open_vectors(spark):
    anchors = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "user_id long, product_id long, rank int")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None)], "product_id long, vector array<double>")
    found = content.taste(anchors, vectors)
    assert "Generate" not in _plan(found)
    assert [(r.user_id, [round(x, 6) for x in r.vector]) for r in found.collect()] == [(1, [0.707107, 0.707107])]


def test_a_search_takes_the_asked_items_against_all(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(120)], "product_id long, vector array<double>")
    asked = vectors.filter("product_id % 50 = 0").select("product_id")
    whole = {(r["item"], r["rank"]): (r.neighbour, r.score) for r in content.similar(vectors, 5).collect() if r["item"] % 50 == 0}
    for block in (8000, 30):
        found = {(r["item"], r["rank"]): (r.neighbour, r.score) for r in content.similar_to(asked, vectors, 5, block=block).collect()}
        assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in whole.items()} and len(found) == 15
        assert all(abs(found[k][1] - whole[k][1]) < 1e-12 for k in found)


def test_the_search_for_similar_products_asks_every_fiftieth(spark):
    found = load()["g13_similar_products"](spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 50 = 0").count()
    assert {r["item"] % 50 for r in found.select("item").distinct().collect()} == {0} and found.count() == 10 * n
