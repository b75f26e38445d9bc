"""Sessions and attribution as keyed state with event-time timers.

A key's state is a few values, whatever has come before, so a batch costs what it brings: a
session is one row that each event widens (the sessions of a hash slot are read and written together), a purchase waits until the watermark has passed it and then
takes the last click before it.  Event ids are remembered until their time is behind
the watermark, so batches that come again change nothing.  State goes to RocksDB, whose snapshots lie with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyrec.streaming.streams import LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE_MS = 7 * 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """State with several values a key needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(times: pd.Series) -> list[int]:
    return [int(t.value) // 1000 for t in times]


def _known(value) -> bool:
    return value is not None and value == value


SESSION_ROWS = "session_key string, user_id long, device_type string, started_at timestamp, ended_at timestamp, event_count long, converted boolean, closed boolean"
#: Slots that sessions are dealt into by their key's hash; a slot's live sessions are one row of state.
SLOTS = 4096
# times in microseconds; a user's and a device's place is the time and id of the event that first had it; of ``ids`` a session has as many as events
_SLOT_STATE = "keys array<string>, started array<long>, ended array<long>, events array<long>, converted array<boolean>, user array<long>, user_at array<long>, user_id array<long>, device array<string>, device_at array<long>, device_id array<long>, ids array<long>"
_SLOT_OUT = "session_key string, user_id long, device_type string, started_us long, ended_us long, event_count long, converted boolean, closed boolean"


def _slot_update(late_ms: int):
    """One row a session: first known user and device, first and last time, events, converted.

    A changed session's row is given out once a batch; with ``closed`` set once more when the watermark is
    ``late_ms`` past its last event, after which its state is gone.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        if state.exists:
            *columns, ids = state.get
            first = 0
            for session, *row in zip(*columns, strict=True):
                held[session] = [*row, dict.fromkeys(ids[first : first + row[2]])]
                first += row[2]
        changed: dict[str, None] = {}
        for frame in frames:
            for session, at, event, owned, owner, kind, what in zip(*(frame[c].tolist() for c in ("session_key", "at", "event_id", "owned", "user_id", "device_type", "event_type")), strict=True):
                row = held.setdefault(session, [at, at, 0, False, None, None, None, None, None, None, {}])
                if event in row[10]:
                    continue
                row[10][event] = None
                changed[session] = None
                row[0], row[1], row[2], row[3] = min(at, row[0]), max(at, row[1]), row[2] + 1, row[3] or what == "PURCHASE"
                if owned and (row[5] is None or (at, event) < (row[5], row[6])):
                    row[4:7] = owner, at, event
                if _known(kind) and kind != "unknown" and (row[8] is None or (at, event) < (row[8], row[9])):
                    row[7:10] = kind, at, event
        passed = state.getCurrentWatermarkMs()
        closed = {session: row for session, row in held.items() if session not in changed and row[1] // 1000 + late_ms <= passed}
        out = [(session, held[session], False) for session in changed] + [(session, row, True) for session, row in closed.items()]
        held = {session: row for session, row in held.items() if session not in closed}
        if held:
            columns = [list(c) for c in zip(*held.values(), strict=True)]
            state.update((list(held), *columns[:10], [event for ids in columns[10] for event in ids]))
            state.setTimeoutTimestamp(max(min(columns[1]) // 1000 + late_ms, passed + 1))
        else:
            state.remove()
        if out:
            value = lambda i: [row[i] for _, row, _ in out]
            yield pd.DataFrame({"session_key": [o[0] for o in out], "user_id": pd.array(value(4), "Int64"), "device_type": [d or "unknown" for d in value(7)], "started_us": value(0), "ended_us": value(1), "event_count": value(2), "converted": value(3), "closed": [o[2] for o in out]})

    return update


def sessions(events: DataFrame, late: str = LATE, late_ms: int = LATE_MS, slots: int = SLOTS) -> DataFrame:
    """Rows of changed sessions, to be read in update mode: the last one of a session stands.

    State is read and written by slot, not by session: calling Python and the state for each session takes
    milliseconds, and there are about half as many sessions as events.
    """
    use_rocksdb(events.sparkSession)
    rows = events.filter("session_key is not null").withWatermark("occurred_at", late).select(
        F.pmod(F.xxhash64("session_key"), F.lit(slots)).alias("slot"), "session_key", "occurred_at", F.unix_micros("occurred_at").alias("at"), "event_id",
        F.col("user_id").isNotNull().alias("owned"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "device_type", "event_type",
    )
    kept = rows.groupBy("slot").applyInPandasWithState(_slot_update(late_ms), _SLOT_OUT, _SLOT_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    times = [F.timestamp_micros(f"{c}_us").alias(f"{c}_at") for c in ("started", "ended")]
    return kept.select("session_key", "user_id", "device_type", *times, "event_count", "converted", "closed")


ATTRIBUTED = "purchase_id long, user_id long, product_id long, click_id long, bought_at timestamp"


class LastClicks(StatefulProcessor):
    """Each purchase of a (user, product) with the last click at most ``hours`` before it.

    A purchase is given out once the watermark has reached it, as no earlier click counts any more.
    Of the clicks that the watermark has passed only the last can still be wanted; the others leave the state.
    """

    def __init__(self, hours: int = 168):
        self.window = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks = handle.getMapState("clicks", "click_id long", "at long")
        self.waiting = handle.getMapState("waiting", "purchase_id long", "at long")
        self.done = handle.getMapState("done", "purchase_id long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, event, kind in zip(_micros(frame["occurred_at"]), frame["event_id"].tolist(), frame["kind"].tolist(), strict=True):
                event = (int(event),)
                if kind == 0:
                    self.clicks.updateValue(event, (at,))
                elif not self.done.containsKey(event) and not self.waiting.containsKey(event):
                    self.waiting.updateValue(event, (at,))
                    self.handle.registerTimer(max(at // 1000 + 1, passed + 1))
        # clicks without a purchase leave by this timer
        newest = max((at for _, (at,) in self.clicks.iterator()), default=None)
        if newest is not None:
            self.handle.registerTimer(max((newest + self.window) // 1000 + 1, passed + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        clicks = sorted((at, event) for (event,), (at,) in self.clicks.iterator())
        due = sorted((at, event) for (event,), (at,) in self.waiting.iterator() if at < passed)
        out = []
        for at, event in due:
            before = [c for c in clicks if c[0] <= at]
            click = before[-1][1] if before and at - before[-1][0] <= self.window else None
            out.append((event, click, at))
            self.waiting.removeKey((event,))
            self.done.updateValue((event,), (at,))
        old = [c for c in clicks if c[0] < passed]
        keep = old[-1:] if old and old[-1][0] >= passed - self.window else []
        for at, event in old:
            if [(at, event)] != keep and not any(a >= at for (_,), (a,) in self.waiting.iterator() if a < passed):
                self.clicks.removeKey((event,))
        for (event,), (at,) in list(self.done.iterator()):
            if at < passed - self.window:
                self.done.removeKey((event,))
        if out:
            yield pd.DataFrame({"purchase_id": [o[0] for o in out], "user_id": [key[0]] * len(out), "product_id": [key[1]] * len(out), "click_id": pd.array([o[1] for o in out], "Int64"), "bought_at": [pd.Timestamp(o[2], unit="us") for o in out]})

    def close(self) -> None:
        pass


def last_clicks(purchases: DataFrame, clicks: DataFrame, hours: int = 168, late: str = LATE) -> DataFrame:
    """One row a purchase, in append mode."""
    use_rocksdb(purchases.sparkSession)
    columns = ["user_id", "product_id", "occurred_at", "event_id"]
    both = clicks.select(*columns, F.lit(0).alias("kind")).unionByName(purchases.select(*columns, F.lit(1).alias("kind")))
    rows = both.filter("user_id is not null and product_id is not null").withWatermark("occurred_at", late)
    return rows.groupBy("user_id", "product_id").transformWithStateInPandas(LastClicks(hours), ATTRIBUTED, "Append", "EventTime")


#: Rows behind the watermark, and why they aren't in the results.
LATE_ROWS = "batch_id long, event_id long, occurred_at timestamp, behind_ms long"


def split_late(batch: DataFrame, newest_ms: int | None, late_ms: int = LATE_MS) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows more than ``late_ms`` behind ``newest_ms``, the newest time of the batches before)."""
    if newest_ms is None:
        return batch, batch.limit(0).select("event_id", "occurred_at", F.lit(0).cast("long").alias("behind_ms"))
    behind = F.lit(newest_ms) - F.unix_millis("occurred_at")
    marked = batch.withColumn("behind_ms", behind)
    return marked.filter(F.col("behind_ms") <= late_ms).drop("behind_ms"), marked.filter(F.col("behind_ms") > late_ms).select("event_id", "occurred_at", "behind_ms")


def accounted(events: DataFrame, folder: str, use, late_ms: int = LATE_MS):
    """A stream writer whose rows in time go to ``use(batch, batch_id)``; late ones to a counted side table ``folder/late``.

    The newest time of the batches before is read from ``folder/clock``, of which a batch writes its own number, so a
    batch that is run again decides the same.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        clock = f"{folder}/clock"
        newest = None
        if batch_id:
            newest = spark.read.schema("batch_id long, newest_ms long").parquet(clock).filter(F.col("batch_id") < batch_id).agg(F.max("newest_ms")).first()[0]
        good, late = split_late(batch, newest, late_ms)
        use(good, batch_id)
        late.withColumn("batch_id", F.lit(batch_id).cast("long")).select("batch_id", "event_id", "occurred_at", "behind_ms").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        seen = batch.agg(F.max(F.unix_millis("occurred_at"))).first()[0]
        now = max((x for x in (seen, newest) if x is not None), default=None)
        spark.createDataFrame([(batch_id, now)], "batch_id long, newest_ms long").write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/_checkpoint")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The side table: one row for each late event and batch."""
    return spark.read.schema(LATE_ROWS).parquet(f"{folder}/late/*")
