"""Features at many cut-offs against the features of each cut-off by itself."""

import math

import pytest
from pyspark.sql import functions as F

from tallyrec.operators import asof, features
from tallyrec.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def cut_days(rows):
    lo, hi = rows.agg(F.min(asof.day_of("occurred_at")), F.max(asof.day_of("occurred_at"))).first()
    return [lo + round(i * (hi + 1 - lo) / 9) for i in range(10)]


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def differences(got, want):
    """Columns in which rows of equal keys differ."""
    assert got.keys() == want.keys()
    return {(k, c) for k in got for c in got[k] if not close(got[k][c], want[k][c])}


def moment(day):
    return F.timestamp_micros(F.lit(day * asof.DAY))


def test_user_features_at_ten_cut_offs(spark, tables):
    rows = tables.rows.filter("user_id is not null").cache()
    days = cut_days(rows)
    partials = asof.user_days(rows, tables.products)
    half = [rows.filter(F.pmod(F.xxhash64("occurred_at"), F.lit(2)) == i) for i in (0, 1)]
    merged = asof.merge_days(*[asof.user_days(h, tables.products) for h in half]).cache()
    keys = ["user_id", "day", "level", "key", "n", "first_us", "last_us"]
    assert sorted(map(str, merged.select(keys).collect())) == sorted(map(str, partials.select(keys).collect()))
    cuts = rows.select("user_id", F.explode(F.array(*map(F.lit, days))).alias("day"))
    found = asof.user_features_at(merged, cuts, tables.orders).collect()
    assert len(found) == 10 * rows.select("user_id").distinct().count()
    for day in days:
        own = {r.user_id: {c: r[c] for c in features.USER_FEATURES} for r in found if r.day == day}
        users = rows.select(F.col("user_id").alias("id")).distinct()
        want = {r.user_id: {c: r[c] for c in features.USER_FEATURES} for r in features.user_features(rows, tables.products, moment(day), tables.orders, users).collect()}
        assert differences(own, want) == set()


def test_product_features_at_ten_cut_offs(spark, tables):
    rows = tables.rows.cache()
    days = cut_days(rows)
    partials = asof.product_days(rows).cache()
    found = asof.product_features_at(partials, tables.products, days).collect()
    for day in days:
        own = {r.product_id: {c: r[c] for c in features.PRODUCT_FEATURES} for r in found if r.day == day}
        want = {r.product_id: {c: r[c] for c in features.PRODUCT_FEATURES} for r in features.product_features(rows, tables.products, moment(day)).collect()}
        assert differences(own, want) == set()


def test_partials_are_all_that_is_read(spark, tables, tmp_path):
    asof.user_days(tables.rows, tables.products).write.parquet(f"{tmp_path}/days")
    cuts = tables.rows.select("user_id", asof.day_of("occurred_at").alias("day"))
    cuts.write.parquet(f"{tmp_path}/cuts")
    plan = asof.user_features_at(spark.read.parquet(f"{tmp_path}/days"), spark.read.parquet(f"{tmp_path}/cuts"))._jdf.queryExecution().optimizedPlan().toString()
    assert "occurred_at" not in plan and "Cartesian" not in plan


def test_users_without_history(spark, tables):
    partials = asof.user_days(tables.rows.limit(0), tables.products)
    cuts = spark.createDataFrame([(1, 19800), (1, 19800), (None, 3), (2, None)], "user_id long, day int")
    rows = asof.user_features_at(partials, cuts).collect()
    assert len(rows) == 1 and rows[0].total_events == 0 and rows[0].price_sensitivity == 0.5 and rows[0].days_since_last_event == 0
