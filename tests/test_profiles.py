"""Sketch profiles against the rows they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import drift, profiles
from tallyrec.plans.registry import load

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 24_000
    rows = zip(range(n), rng.integers(0, 12, n).tolist(), rng.normal(size=n).tolist(), rng.exponential(5, n).round(1).tolist(), rng.integers(0, 4, n).astype(float).tolist(), strict=True)
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, day int, a double, b double, c double")
    late = F.col("day") >= 6
    return df.withColumn("a", F.when(late, F.col("a") * 1.2 + 0.3).otherwise(F.col("a"))).withColumn("c", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("c"))).withColumn("d", F.lit(7.0)).cache()


def test_windows_compare_as_their_rows_do(spark, frame):
    features = ["a", "b", "c", "d"]
    kept = profiles.daily_profiles(frame, features)
    got = {r.feature: r for r in profiles.compare_profiles(profiles.window_profile(kept, 0, 5), profiles.window_profile(kept, 6, 11)).collect()}
    want = {r.feature: r for r in drift.compare(frame.filter("day < 6"), frame.filter("day >= 6"), features).collect()}
    assert got.keys() == want.keys()
    slack = 2 * (profiles.rank_error() + 0.5 / profiles.STEPS)
    for f in features:
        assert got[f].ks == pytest.approx(want[f].ks, abs=slack + 1 / 100)
        assert got[f].psi == pytest.approx(want[f].psi, abs=0.01) and got[f].severity == want[f].severity
        assert got[f].reference_n == want[f].reference_n and got[f].current_n == want[f].current_n
        assert got[f].reference_mean == pytest.approx(want[f].reference_mean) and got[f].current_mean == pytest.approx(want[f].current_mean)
    # few distinct values are told apart exactly, ties included
    assert got["c"].ks == pytest.approx(want["c"].ks, abs=slack) and got["d"].psi == 0 and got["d"].ks == 0
    assert got["a"].psi > 0.05


def test_ranks_are_within_the_stated_error(spark, frame):
    kept = profiles.daily_profiles(frame, ["a"])
    whole = profiles.window_profile(kept, 0, 11)
    values = np.sort([r.a for r in frame.select("a").collect()])
    at = [-2.0, -0.5, 0.0, 0.7, 2.0]
    ranks = whole.select(F.kll_sketch_get_rank_double("sketch", F.array(*map(F.lit, at))).alias("r")).first().r
    assert max(abs(r - np.searchsorted(values, x, side="right") / len(values)) for r, x in zip(ranks, at, strict=True)) <= profiles.rank_error()


def test_old_days_are_not_read_again(spark, frame, tmp_path):
    profiles.daily_profiles(frame.filter("day < 11"), ["a"]).write.parquet(f"{tmp_path}/profiles")
    profiles.daily_profiles(frame.filter("day = 11"), ["a"]).write.mode("append").parquet(f"{tmp_path}/profiles")
    kept = spark.read.parquet(f"{tmp_path}/profiles")
    assert kept.count() == 12
    plan = profiles.compare_profiles(profiles.window_profile(kept, 0, 5), profiles.window_profile(kept, 6, 11))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "LogicalRDD" not in plan


def test_thirteen_features_are_compared(spark):
    rows = {r.feature: r for r in load()["n5_profiles"](spark, SF).collect()}
    assert set(rows) == {*profiles.USER_WATCH, *profiles.PRODUCT_WATCH} and len(rows) == 13
    assert rows["price"].psi < 0.01  # the same catalogue on all days
    assert rows["days_since_release"].ks > 0


def test_audiences(spark):
    n = 60_000
    events = spark.range(n).select(F.col("id").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 10) * 86_400).alias("occurred_at"), (F.col("id") % 3).cast("string").alias("surface"), F.lit("x").alias("device"))
    events = events.unionByName(events.filter("user_id < 30000").withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 10 days"))).unionByName(events.limit(5).withColumn("user_id", F.lit(None).cast("long")))
    kept = profiles.daily_audience(events, ["surface", "device"])
    first = kept.agg(F.min("day")).first()[0]
    early, late = profiles.audience(kept, first, first + 9, ["surface"]), profiles.audience(kept, first + 10, first + 19, ["surface"])
    rows = profiles.overlap(early, late, ["surface"]).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.a_users == pytest.approx(20_000, rel=0.03) and r.b_users == pytest.approx(10_000, rel=0.03)
        assert r.both == pytest.approx(10_000, rel=0.05) and r.either == pytest.approx(20_000, rel=0.03)
    # slices add up without users counted twice
    assert profiles.reach(profiles.audience(kept, first, first + 19, [])).first().users == pytest.approx(n, rel=0.03)
    one = profiles.audience(kept, first, first, ["surface"])
    assert {r.surface: r.users for r in profiles.reach(one).collect()} == {str(s): 2000 for s in range(3)}
    none = profiles.overlap(one, profiles.audience(kept, first + 99, first + 100, ["surface"]), ["surface"]).collect()
    assert all((r.b_users, r.both, r.either) == (0, 0, 2000) for r in none)
