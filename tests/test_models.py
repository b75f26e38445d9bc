"""Values of the content, collaborative and ranking models against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover

from tallyrec.operators import collaborative, content, ranking

TEXTS = {1: "red wooden chair with a red seat", 2: "wooden table", 3: "the red table and chair", 4: "", 5: "wooden wooden wooden spoon", 6: "red chair"}


def test_tfidf(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "product_id long, text string")
    got = {r.product_id: np.array(r.v) for r in content.tfidf(texts)(texts).select("product_id", content.vector_to_array("vector").alias("v")).collect()}
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    terms = {}
    for k, text in TEXTS.items():
        words = [w for w in text.lower().split() if len(w) > 1 and w not in stop]
        terms[k] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    df = Counter(t for c in terms.values() for t in c)
    kept = {t for t, n in df.items() if n >= 2}
    want = {}
    for k, c in terms.items():
        row = {t: (1 + math.log(n)) * math.log((len(TEXTS) + 1) / (df[t] + 1)) for t, n in c.items() if t in kept}
        size = math.sqrt(sum(x * x for x in row.values())) or 1.0
        want[k] = sorted(x / size for x in row.values() if x)
    assert len(got[1]) == len(kept)
    for k in TEXTS:
        assert sorted(x for x in got[k] if x) == pytest.approx(want[k])
    # products are as like as their plain vectors
    plain = {k: {t: (1 + math.log(n)) * math.log((len(TEXTS) + 1) / (df[t] + 1)) for t, n in c.items() if t in kept} for k, c in terms.items()}
    dot = lambda a, b: sum(x * plain[b].get(t, 0) for t, x in plain[a].items())
    assert got[1] @ got[3] == pytest.approx(dot(1, 3) / math.sqrt(dot(1, 1) * dot(3, 3)))


def test_attributes_and_combination(spark):
    rows = [(1, "a", "x", "low", 1.0), (2, "a", "y", "high", 9.0), (3, "b", "y", "high", 4.0), (4, "a", "y", "low", 2.0)]
    got = {r.product_id: np.array(r.attributes) for r in content.attribute_vectors(spark.createDataFrame(rows, "id long, category_id string, brand_id string, price_band string, price double")).collect()}
    logs = [math.log1p(r[4]) for r in rows]
    for r, log in zip(rows, logs, strict=True):
        assert got[r[0]][-1] == pytest.approx((log - min(logs)) / (max(logs) - min(logs)))
        assert sorted(got[r[0]][:-1]) == pytest.approx([0.0] * (len(got[r[0]]) - 4) + [1.0] * 3)
    for a in rows:
        for b in rows:
            assert got[a[0]][:-1] @ got[b[0]][:-1] == sum(x == y for x, y in zip(a[1:4], b[1:4], strict=True))
    rng = np.random.default_rng(1)
    text = {k: rng.normal(size=3) for k in got}
    text[4] = np.zeros(3)
    both = content.combine(spark.createDataFrame([(k, v.tolist()) for k, v in text.items()], "product_id long, vector array<double>"), spark.createDataFrame([(k, v.tolist()) for k, v in got.items()], "product_id long, attributes array<double>"))
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    for r in both.collect():
        assert r.vector == pytest.approx(unit(np.concatenate([0.6 * unit(text[r.product_id]), 0.4 * unit(got[r.product_id])])).tolist())


def test_taste_is_the_mean_of_the_first_anchors(spark):
    rng = np.random.default_rng(2)
    vectors = {p: rng.normal(size=4) for p in range(10)}
    anchors = [(1, p, p + 1) for p in range(6)] + [(2, 9, 1), (3, 77, 1)]
    got = {r.user_id: r.vector for r in content.taste(spark.createDataFrame(anchors, "user_id long, product_id long, rank int"), spark.createDataFrame([(p, v.tolist()) for p, v in vectors.items()], "product_id long, vector array<double>"), keep=4).collect()}
    mean = np.mean([vectors[p] for p in range(4)], axis=0)
    assert set(got) == {1, 2} and got[1] == pytest.approx((mean / np.linalg.norm(mean)).tolist())
    assert got[2] == pytest.approx((vectors[9] / np.linalg.norm(vectors[9])).tolist())


def test_fold_in(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, vector array<double>")
    items = spark.createDataFrame([(10, [2.0, 4.0]), (11, [0.0, 2.0])], "product_id long, vector array<double>")
    touched = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 99)], "user_id long, product_id long")
    got = {r.user_id: r.vector for r in collaborative.fold_in(collaborative.Factors(users, items), touched).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 3.0], 3: [0.0, 2.0]}


COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for u in range(60):
        for p in range(12):
            a, b, c = rng.normal(size=3)
            out.append((u, p, int(np.clip(round(2 * a - b + 0.3 * rng.normal()), 0, 3)), float(a), float(b), float(c)))
    return spark.createDataFrame(out, "user_id long, product_id long, label int, a double, b double, c double").cache()


def test_pairs_of_the_pairwise_ranker(spark, rows):
    one = rows.filter("user_id < 3")
    got = ranking.pairwise_rows(one, COLUMNS, each=100).collect()
    data = [tuple(r) for r in one.collect()]
    want = []
    for u in range(3):
        mine = sorted((r for r in data if r[0] == u), key=lambda r: (-r[2], r[1]))
        for i, x in enumerate(mine, 1):
            for j, y in enumerate(mine, 1):
                if x[2] > y[2]:
                    cost = abs((2 ** x[2] - 2 ** y[2]) * (1 / math.log2(i + 1) - 1 / math.log2(j + 1)))
                    want.append((u, tuple(round(x[k] - y[k], 9) for k in (3, 4, 5)), round(max(cost, 1e-3), 9)))
    signed = [(r.user_id, tuple(round((2 * r.target - 1) * r[c], 9) for c in COLUMNS), round(r.weight, 9)) for r in got]
    assert sorted(signed) == sorted(want)
    assert 0.3 < np.mean([r.target for r in got]) < 0.7


def test_rankers_order_by_what_counts(spark, rows):
    for model in (ranking.pointwise(rows, COLUMNS), ranking.pairwise(rows, COLUMNS)):
        scored = ranking.score_pool(model, rows, 12).join(rows, ["user_id", "product_id"]).toPandas()
        assert scored.groupby("user_id").apply(lambda f: f["score"].rank().corr(f["label"].rank()), include_groups=False).mean() > 0.6
        shares = {r.feature: r.share for r in ranking.importances(model, spark, COLUMNS).collect()}
        assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["b"] > shares["c"]
    trees = ranking.gain_trees(rows, COLUMNS, trees=5, depth=3)
    fitted = trees.transform(rows).selectExpr("prediction", "power(2, label) - 1 as gain").toPandas()
    assert fitted["prediction"].corr(fitted["gain"]) > 0.7


def test_attributions_are_coefficient_times_scaled_value(spark, rows):
    model = ranking.pointwise(rows, COLUMNS)
    got = {(r.user_id, r.product_id, r.feature): (r.effect, r["rank"]) for r in ranking.attributions(model, rows, COLUMNS, keep=2).collect()}
    data = rows.toPandas()
    weights = model.stages[-1].coefficients.toArray()
    scaled = (data[list(COLUMNS)] - data[list(COLUMNS)].mean()) / data[list(COLUMNS)].std()
    for i in range(0, len(data), 97):
        effects = {c: weights[k] * scaled.iloc[i, k] for k, c in enumerate(COLUMNS)}
        best = sorted(effects, key=lambda c: (-abs(effects[c]), c))[:2]
        key = int(data["user_id"][i]), int(data["product_id"][i])
        assert [(*key, c) in got for c in best] == [True, True]
        for place, c in enumerate(best, 1):
            assert got[(*key, c)] == (pytest.approx(effects[c], rel=1e-6, abs=1e-9), place)


def test_ranking_rows_take_each_feature_once(spark):
    """The assembled row is the user's, product's, pair's and sources' columns side by side."""
    users = spark.createDataFrame([(1, *[float(i) for i in range(len(ranking.USER_FEATURES))])], ["user_id", *ranking.USER_FEATURES])
    named = {"category_id": "chairs", "brand_id": "acme"}
    products = spark.createDataFrame([(7, *[named.get(c, float(100 + i)) for i, c in enumerate(ranking.PRODUCT_FEATURES)])], ["product_id", *ranking.PRODUCT_FEATURES])
    pairs = spark.createDataFrame([(1, 7, *[float(200 + i) for i in range(len(ranking.PAIR_FEATURES))])], ["user_id", "product_id", *ranking.PAIR_FEATURES])
    sources = spark.createDataFrame([(1, 7, *[float(300 + i) for i in range(len(ranking.SOURCE_FEATURES))]), (1, 8, *[0.5] * len(ranking.SOURCE_FEATURES))], ["user_id", "product_id", *ranking.SOURCE_FEATURES])
    got = {r.product_id: r.asDict() for r in ranking.assemble(users, products, pairs, sources).collect()}
    assert list(got[7]) == ["user_id", "product_id", *ranking.FEATURES] and len(ranking.FEATURES) == 83
    for i, c in enumerate(ranking.USER_FEATURES):
        assert got[7][f"user_{c}"] == got[8][f"user_{c}"] == i
    for i, c in enumerate(ranking.PRODUCT_FEATURES):
        assert (0 <= got[7][f"product_{c}"] < 10_000 if c in named else got[7][f"product_{c}"] == 100 + i) and got[8][f"product_{c}"] == 0
    for i, c in enumerate(ranking.PAIR_FEATURES):
        assert got[7][c] == 200 + i and got[8][c] == 0
    for i, c in enumerate(ranking.SOURCE_FEATURES):
        assert got[7][c] == 300 + i


def test_a_pools_label_goes_with_its_features(spark):
    gathered = spark.createDataFrame([(1, 7, "content", 0.5, 0), (1, 8, "popularity", 0.1, 1)], "user_id long, product_id long, source string, score double, rank int")
    pool = spark.createDataFrame([(1, 7, 1, 3), (1, 8, 2, 0)], "user_id long, product_id long, rank int, label int")
    sources = ranking.source_features(gathered, pool)
    assert {r.product_id: (r.label, r.candidate_rank) for r in sources.collect()} == {7: (3, 1), 8: (0, 2)}
    users = spark.createDataFrame([(1, *[1.0] * len(ranking.USER_FEATURES))], ["user_id", *ranking.USER_FEATURES])
    products = spark.createDataFrame([(7, *[2.0] * len(ranking.PRODUCT_FEATURES))], ["product_id", *ranking.PRODUCT_FEATURES])
    pairs = spark.createDataFrame([(1, 7, *[3.0] * len(ranking.PAIR_FEATURES))], ["user_id", "product_id", *ranking.PAIR_FEATURES])
    rows = ranking.assemble(users, products, pairs, sources)
    assert rows.columns == ["user_id", "product_id", *ranking.FEATURES, "label"]
    assert {r.product_id: (r.label, r.user_total_events, r.product_price) for r in rows.collect()} == {7: (3, 1.0, 2.0), 8: (0, 1.0, 0.0)}
