"""Queries that write to the shared folder and read back: sources, partitions, artefacts, streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.plans.queries_base import SESSION_SQL, shown
from tallyrec.plans.registry import Tables, on, register
from tallyrec.session import scratch
from tallyrec.sources import io
from tallyrec.sources.schemas import TABLES
from tallyrec.streaming import keyed, streams

STORED = ("events", "products", "orders", "order_items", "users")


def read_back(t: Tables) -> DataFrame:
    """All tables of the data set under their declared schemas, written to a folder and read from it."""
    folder = scratch(t.spark, "tables")
    for name in STORED:
        io.shaped(getattr(t.data, name), TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    found = io.read_parquet(t.spark, folder, STORED)
    rows = None
    for name in STORED:
        one = getattr(found, name).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(found.tables()[name].columns)).alias("n_columns")).select(F.lit(name).alias("name"), "n_rows", "n_columns")
        rows = one if rows is None else rows.unionByName(one)
    return rows


COLUMNS_SQL = " ".join(f"when '{name}' then {len(TABLES[name].split(', '))}" for name in STORED)
register(
    "a1_read_tables",
    on(read_back),
    f"with c as (select 'events' as name, count(*) as n_rows from ev union all select 'products', count(*) from prod union all select 'orders', count(*) from orders union all select 'order_items', count(*) from lineitem union all select 'users', count(*) from customer) select name, n_rows, case name {COLUMNS_SQL} end as n_columns from c",
    "ev prod",
)


def of_days(t: Tables) -> DataFrame:
    """Events of ten days from a month-partitioned folder."""
    path = scratch(t.spark, "events")
    io.write_events(t.events, path)
    return io.read_events(t.spark, path, datetime(2024, 1, 10), datetime(2024, 1, 20)).select("event_id", "event_type", F.unix_micros("occurred_at").alias("us"))


register("a9_events_of_days", on(of_days), "select event_id, event_type, us from ev where occurred_at >= timestamp '2024-01-10' and occurred_at < timestamp '2024-01-20'", "ev")


def artefacts(t: Tables) -> DataFrame:
    """Two tables of a run, read back from its folder."""
    folder = scratch(t.spark, "runs")
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    io.write_artefacts({"counts": counts, "fingerprint": counts.limit(0)}, folder, "run-1")
    io.write_artefacts({"counts": counts}, folder, "run-2")
    return t.spark.read.parquet(f"{folder}/run-1/counts").unionByName(t.spark.read.parquet(f"{folder}/run-2/counts"))


register("a10_artefacts", on(artefacts), "select event_type, count(*) as n from ev, range(2) group by event_type, range", "ev")


def event_stream(t: Tables, folder: str) -> DataFrame:
    """The events as a stream of four batches, week by week; their payloads have other keys than the domain's and are left out."""
    names = [c.split()[0] for c in streams.EVENT_COLUMNS.split(", ")]
    rows = t.events.withColumn("event_metadata", F.lit(None).cast("string")).select(*names)
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    for week in range(4):  # the fourth has the rest of the month
        rows.filter(F.least(F.floor((F.dayofmonth("occurred_at") - 1) / 7), F.lit(3)) == week).repartition(tasks, "event_id").write.parquet(f"{folder}/in/week={week}")
    return streams.read_events(t.spark, f"{folder}/in/*", files_per_trigger=tasks)


def ingested(t: Tables) -> DataFrame:
    """Sessions that a validated, deduplicated stream has merged; a day after the last event, so that only the last six days aren't too old."""
    folder = scratch(t.spark, "ingest")
    moment = t.events.agg(F.max("occurred_at")).first()[0] + timedelta(days=1)
    query = streams.ingest(event_stream(t, folder), f"{folder}/out", moment).trigger(availableNow=True).start()
    query.awaitTermination()
    return shown(streams.read_version(t.spark, f"{folder}/out/sessions"))


def streamed_sessions(t: Tables) -> DataFrame:
    """Sessions kept as keyed state: of each session the row of the last batch that changed it."""
    folder = scratch(t.spark, "sessions")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        query = keyed.sessions(event_stream(t, folder)).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = t.spark.read.schema(keyed.SESSION_ROWS + ", batch int").parquet(f"{folder}/out").drop("closed")
    names = [c for c in rows.columns if c not in ("batch", "session_key")]
    last = rows.groupBy("session_key").agg(F.max_by(F.struct(*names), F.struct("batch", "event_count")).alias("last"))
    return shown(last.select("session_key", "last.*"))


register(
    "a7_ingested_sessions",
    on(ingested),
    f"with ok as (select * from ev, clock where us >= now_us - 6 * 86400000000 and product_id > 0 and event_type is not null), {SESSION_SQL.replace('from ev', 'from ok')} select * from se",
    "ev clock",
)
register("b18_streamed_sessions", on(streamed_sessions), f"with {SESSION_SQL} select * from se", "ev")
