"""Keyed state gives what the batch queries give, whatever order, lateness and repetition rows come in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrec.operators import analytics, counters
from tallyrec.streaming import keyed, streams

START = datetime(2024, 3, 1)


def events(n=240, seed=1):
    rng = random.Random(seed)
    kinds = ["PRODUCT_VIEW", "PRODUCT_CLICK", "PURCHASE", "ADD_TO_CART"]
    return [
        (i, START + timedelta(minutes=rng.randrange(4000)), rng.choice(kinds), rng.choice([None, 1, 2, 3]), f"s{rng.randrange(12)}", rng.randrange(1, 4), "web", rng.choice(["mobile", "desktop", "unknown"]), None)
        for i in range(n)
    ]


def batches(spark, path, parts):
    """One file a batch, in the order given."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, streams.EVENT_COLUMNS).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    return streams.read_events(spark, f"{path}/in/*", files_per_trigger=1)


def run(stream, name, path, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return stream.sparkSession.table(name)


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_sessions_equal_the_batch_roll_up(spark, tmp_path):
    rows = events()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    parts = [shuffled[:80], shuffled[80:160], shuffled[40:120], shuffled[160:]]  # the third comes again
    got = run(keyed.sessions(batches(spark, tmp_path, parts)), "keyed_sessions", tmp_path, "update").collect()
    last = {}
    for r in got:
        if r.session_key not in last or r.event_count >= last[r.session_key][5]:
            last[r.session_key] = tuple(r)[:-1]
    want = {r.session_key: tuple(r) for r in counters.roll_up_sessions(spark.createDataFrame(rows, streams.EVENT_COLUMNS)).collect()}
    assert last == want


def test_sessions_leave_the_state(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i), "PRODUCT_VIEW", 1, "old", 1, "web", "mobile", None) for i in range(5)]
    later = [(100 + i, START + timedelta(days=9, minutes=i), "PRODUCT_VIEW", 1, "new", 1, "web", "mobile", None) for i in range(3)]
    last = [(200, START + timedelta(days=24), "PRODUCT_VIEW", 1, "newest", 1, "web", "mobile", None)]
    got = run(keyed.sessions(batches(spark, tmp_path, [rows, later, last])), "keyed_leave", tmp_path, "update").collect()
    closed = {r.session_key: r.event_count for r in got if r.closed}
    assert closed == {"old": 5, "new": 3}


def test_state_is_kept_by_slot(spark, tmp_path):
    """Rows of state for each session, event id and timer cost milliseconds each (b18_streamed_sessions)."""
    rows = events(400, 7)
    query = keyed.sessions(batches(spark, tmp_path, [rows[:200], rows[200:], rows[:100]]), slots=3).writeStream.format("memory").queryName("keyed_slots").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
    last = {r.session_key: tuple(r)[:-1] for r in spark.table("keyed_slots").orderBy("event_count").collect()}
    assert last == {r.session_key: tuple(r) for r in counters.roll_up_sessions(spark.createDataFrame(rows, streams.EVENT_COLUMNS)).collect()}


def test_last_clicks_equal_the_batch_attribution(spark, tmp_path):
    rows = [(i, t, kind, u or 1, s, p, *x) for i, t, kind, u, s, p, *x in events(300, 5)]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    end = [(10**6, START + timedelta(days=30), "PRODUCT_VIEW", 1, "end", 1, "web", "mobile", None), (10**6 + 1, START + timedelta(days=30), "PRODUCT_CLICK", 9, "end", 9, "web", "mobile", None)]
    more = [(10**6 + 2, START + timedelta(days=40), "PRODUCT_CLICK", 9, "end", 9, "web", "mobile", None)]
    stream = batches(spark, tmp_path, [shuffled[:100], shuffled[100:200], shuffled[50:150], shuffled[200:], end, more])
    kind = lambda df, k: df.filter(F.col("event_type") == k)
    got = run(keyed.last_clicks(kind(stream, "PURCHASE"), kind(stream, "PRODUCT_CLICK"), hours=20), "keyed_clicks", tmp_path, "append").collect()
    whole = spark.createDataFrame(rows, streams.EVENT_COLUMNS)
    want = analytics.attribute(kind(whole, "PURCHASE"), kind(whole, "PRODUCT_CLICK"), hours=20)
    assert sorted((r.purchase_id, r.user_id, r.product_id, r.click_id or 0) for r in got) == sorted((r.purchase_id, r.user_id, r.product_id, r.click_id or 0) for r in want.collect())
    assert any(r.click_id for r in got) and not all(r.click_id for r in got)


def test_late_rows_are_counted(spark, tmp_path):
    now = START + timedelta(days=20)
    row = lambda i, t: (i, t, "PRODUCT_VIEW", 1, "s", 1, "web", "mobile", None)
    parts = [[row(1, now)], [row(2, now - timedelta(days=6)), row(3, now - timedelta(days=8)), row(4, now + timedelta(days=1))], [row(5, now - timedelta(days=6, hours=1)), row(6, now - timedelta(days=5))]]
    used = []
    writer = keyed.accounted(batches(spark, tmp_path, parts), f"{tmp_path}/out", lambda df, k: used.extend((k, r.event_id) for r in df.collect()))
    assert writer.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(used) == [(0, 1), (1, 2), (1, 4), (2, 6)]
    late = [(r.batch_id, r.event_id, r.behind_ms) for r in keyed.late_rows(spark, f"{tmp_path}/out").orderBy("event_id").collect()]
    assert late == [(1, 3, 8 * 86_400_000), (2, 5, 7 * 86_400_000 + 3_600_000)]
    assert sum(map(len, parts)) == len(used) + len(late)
