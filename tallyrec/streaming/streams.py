"""Streaming forms of the ingestion operators.

Sessions and attribution accept events up to seven days late; trending reads
only a day of buckets, so its watermark is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyrec.config import REFRESH_TYPES
from tallyrec.operators import counters, validation
from tallyrec.sources.io import write_events

LATE, TREND_LATE = "7 days", "2 hours"
EVENT_COLUMNS = "event_id long, occurred_at timestamp, event_type string, user_id long, session_key string, product_id long, source string, device_type string, event_metadata string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: str = EVENT_COLUMNS) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unique(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events once each, though clients send them again."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def trend_buckets(events: DataFrame, categories: DataFrame | None = None, late: str = TREND_LATE) -> DataFrame:
    return counters.hourly_buckets(events.withWatermark("occurred_at", late), categories)


def users_to_refresh(events: DataFrame, late: str = LATE) -> DataFrame:
    """Users with a strong signal, once while the watermark lasts."""
    strong = events.filter(F.col("event_type").isin(*REFRESH_TYPES) & F.col("user_id").isNotNull())
    return strong.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "occurred_at")


def request_limits(requests: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    counts = requests.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select(F.col("w.start").alias("minute"), "user_id", "n")


def keyless_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions by gaps, for sources that send no session key."""
    return events.withWatermark("occurred_at", late).groupBy(F.session_window("occurred_at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


def recent_lists(events: DataFrame, key: str, *, distinct: bool, cap: int = 50, ttl_hours: int = 24 * 30) -> DataFrame:
    """``key, products`` (newest first), kept as state; ``distinct`` moves a product to the front instead of repeating it.

    A list is dropped once the events' time has passed its last one by ``ttl_hours``.
    """

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for frame in frames:
            held += [(int(t.value), int(e), int(p)) for t, e, p in zip(frame["occurred_at"], frame["event_id"], frame["product_id"], strict=True)]
        held.sort(reverse=True)
        if distinct:
            seen: set[int] = set()
            held = [h for h in held if not (h[2] in seen or seen.add(h[2]))]
        held = held[:cap]
        state.update(tuple(list(x) for x in zip(*held, strict=True)))
        expiry = held[0][0] // 1_000_000 + ttl_hours * 3_600_000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]], "products": [[h[2] for h in held]]})

    kinds = ("PRODUCT_VIEW",) if distinct else ("PRODUCT_VIEW", "PRODUCT_CLICK")
    looked = events.filter(F.col("event_type").isin(*kinds) & F.col("product_id").isNotNull() & F.col(key).isNotNull())
    kind = dict(looked.dtypes)[key]
    return looked.withWatermark("occurred_at", LATE).select(key, "occurred_at", "event_id", "product_id").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, products array<long>", "at array<long>, ids array<long>, products array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def session_merger(path: str):
    """A ``foreachBatch`` function that merges a batch's sessions into versions of a table under ``path``.

    A batch writes version ``batch + 1`` from the one before, so that running it again gives the same; versions
    before that one are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rolled = counters.roll_up_sessions(batch)
        stored = read_version(spark, path, batch_id)
        merged = rolled if stored is None else counters.merge_sessions(stored, rolled)
        merged.write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("version=") and int(name.split("=")[1]) < batch_id:
                fs.delete(status.getPath(), True)

    return merge


def read_version(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest session table, or the newest of at most ``upto``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    found = [v for v in found if upto is None or v <= upto]
    return spark.read.parquet(f"{path}/version={max(found)}") if found else None


def ingest(events: DataFrame, folder: str, now: datetime | None = None):
    """Validate a stream, each event once, and fan it out: month-partitioned events, merged sessions, rejects."""
    merge = session_merger(f"{folder}/sessions")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        clock = F.lit(now) if now is not None else F.current_timestamp()
        checked = validation.validate(batch, clock)
        good = validation.accepted(checked).drop("payload")
        # a batch that is run again writes its own folders again
        write_events(good, f"{folder}/events/batch_id={batch_id}", mode="overwrite")
        merge(good, batch_id)
        validation.rejected(checked).select("event_id", "reasons").write.mode("overwrite").parquet(f"{folder}/rejects/batch_id={batch_id}")
        batch.unpersist()

    return unique(events).writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/_checkpoint")


def attribute_stream(purchases: DataFrame, clicks: DataFrame, hours: int = 168) -> DataFrame:
    """Purchases joined with the clicks of the hours before them (all of them; the last is chosen downstream)."""
    p = purchases.select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"), F.col("product_id").alias("p_product"), F.col("occurred_at").alias("bought_at")).withWatermark("bought_at", LATE)
    c = clicks.select(F.col("event_id").alias("click_id"), F.col("user_id").alias("c_user"), F.col("product_id").alias("c_product"), F.col("occurred_at").alias("clicked_at")).withWatermark("clicked_at", LATE)
    inside = (F.col("p_user") == F.col("c_user")) & (F.col("p_product") == F.col("c_product")) & (F.col("clicked_at") <= F.col("bought_at")) & (F.col("clicked_at") >= F.col("bought_at") - F.expr(f"interval {hours} hours"))
    return p.join(c, inside)
