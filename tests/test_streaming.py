"""Streams give what the same batch gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrec.operators import counters
from tallyrec.streaming import streams

START = datetime(2024, 3, 1)


@pytest.fixture
def source(spark, tmp_path):
    kinds = ["PRODUCT_VIEW", "PRODUCT_CLICK", "PURCHASE", "PRODUCT_VIEW"]
    rows = [(i, START + timedelta(minutes=7 * i), kinds[i % 4], i % 3, f"session-{i % 5}", i % 6 + 1, "web", "mobile" if i % 2 else "unknown", None) for i in range(60)]
    df = spark.createDataFrame(rows, streams.EVENT_COLUMNS)
    df.filter("event_id < 30").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.filter("event_id >= 30").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = streams.read_events(spark, f"{tmp_path}/in/*", files_per_trigger=1)
    return df, stream, tmp_path


def run(stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_trend_buckets(spark, source):
    df, stream, path = source
    got = run(streams.trend_buckets(stream), "buckets", path, "update").groupBy("bucket_start", "product_id").agg(F.max("score").alias("score"))
    want = counters.hourly_buckets(df).select("bucket_start", "product_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recent_lists(spark, source):
    df, stream, path = source
    rows = run(streams.recent_lists(stream, "user_id", distinct=True), "lists", path, "update").collect()
    got = {r.user_id: r.products for r in rows}  # the last update of a user stands
    want = {}
    for r in counters.recently_viewed(df).orderBy("user_id", "rank").collect():
        want.setdefault(r.user_id, []).append(r.product_id)
    assert got == want


def test_ingest_merges_sessions(spark, source):
    df, stream, path = source
    query = streams.ingest(stream, f"{path}/out", START + timedelta(days=1)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert spark.read.parquet(f"{path}/out/events").count() == 60
    got = streams.read_version(spark, f"{path}/out/sessions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counters.roll_up_sessions(df).collect()))
