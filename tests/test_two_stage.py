"""The two-stage run on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from tallyrec.operators import ranking, split
from tallyrec.plans import two_stage
from tallyrec.sources import adapters

SF = "/root/testdata/sf0.001"
VARIANTS = {
    "popularity-global", "popularity-category", "trending", "covisitation", "content", "collaborative-als", "hybrid", "hybrid + diversity",
    "two-stage-logistic", "two-stage-logistic + diversity", "two-stage-ranker", "two-stage-ranker + diversity",
}


@pytest.fixture(scope="module")
def parts(spark):
    data = adapters.dataset(spark, SF)
    folds = split.split_temporal(data.interactions())
    past = folds.filter("fold = 'train'").drop("fold")
    cut = folds.filter("fold <> 'train'").agg(F.unix_micros(F.min("occurred_at"))).first()[0]
    users = folds.filter("fold <> 'train'").select("user_id").distinct()
    found = two_stage.Retrieval(past, data, F.timestamp_micros(F.lit(cut).cast("long")), users, als={"factors": 4, "rounds": 2}, rank=16)
    return data, folds, found


def test_every_source_and_no_leak(spark, parts):
    data, folds, found = parts
    assert len(found.sources()) == 10
    assert {r.source for r in found.gathered.select("source").distinct().collect()} >= {"collaborative", "content", "category_affinity", "brand_affinity", "trending", "popularity"}
    good = data.products.filter("is_active and stock_quantity > 0").select(F.col("id").alias("product_id"))
    assert found.pool.join(good, "product_id", "left_anti").count() == 0
    assert found.gathered.join(found.bought, ["user_id", "product_id"]).count() == 0
    rows = found.rows()
    assert rows.columns == ["user_id", "product_id", *ranking.FEATURES] and rows.count() == found.pool.count()
    assert rows.agg(F.sum("content_similarity")).first()[0] > 0


def test_all_variants_are_measured(spark, parts):
    data, folds, found = parts
    wanted = ranking.labels(folds.filter("fold = 'validation'"))
    lists = two_stage.variants(found, wanted, 10, boosting={"rounds": 3, "least_rows": 2, "rate": 0.3})
    assert set(lists) == VARIANTS
    for name in ("two-stage-ranker", "hybrid + diversity"):
        got = lists[name]
        assert got.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 10
        assert got.join(found.pool.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti").count() == 0
        assert got.groupBy("user_id", "rank").count().filter("count > 1").count() == 0
