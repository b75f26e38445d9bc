"""Typed loading and saving of the domain tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.config import SCOPED_TYPES
from tallyrec.functions.columns import unsent
from tallyrec.sources.schemas import JSON_COLUMNS, TABLES


@dataclass
class Dataset:
    """The domain tables, kept apart."""

    events: DataFrame
    products: DataFrame
    categories: DataFrame | None = None
    brands: DataFrame | None = None
    users: DataFrame | None = None
    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    user_sessions: DataFrame | None = None

    def interactions(self) -> DataFrame:
        return interactions(self.events, self.products)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}


def interactions(events: DataFrame, products: DataFrame) -> DataFrame:
    """Product-scoped events with their product's category, brand, price and band.

    The catalogue isn't sent to the tasks, as it grows with the shop (:func:`unsent`).
    """
    scoped = events.filter(F.col("event_type").isin(*SCOPED_TYPES) & F.col("product_id").isNotNull())
    meta = products.select(F.col("id").alias("product_id"), "category_id", "brand_id", "price", "price_band")
    return scoped.select("occurred_at", "event_type", F.col("user_id").cast("long"), "session_key", F.col("product_id").cast("long")).join(unsent(meta), "product_id", "left")


def time_span(events: DataFrame) -> DataFrame:
    return events.agg(F.unix_micros(F.min("occurred_at")).alias("first_us"), F.unix_micros(F.max("occurred_at")).alias("last_us"), F.count(F.lit(1)).alias("n_events"))


def decode_json(df: DataFrame, table: str) -> DataFrame:
    """JSON text columns of ``table`` as maps and arrays; broken text becomes null."""
    for (owner, column), kind in JSON_COLUMNS.items():
        if owner == table and column in df.columns:
            df = df.withColumn(column, F.from_json(column, kind))
    return df


def encode_json(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON text, for sinks that want flat columns."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("map", "array", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def read_parquet(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> Dataset:
    """All tables of a folder; a missing one raises when it is first planned."""
    found = {}
    for name in only or tuple(TABLES):
        found[name] = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    return Dataset(**found)


def read_jdbc(spark: SparkSession, url: str, months: list[tuple[datetime, datetime]], properties: dict | None = None) -> Dataset:
    """The same tables from a database; events by month, one partition each, bounds half open."""
    # quoted as Spark's own filters are, with times in JDBC's own form, which every driver turns into its database's
    parts = [f"\"occurred_at\" >= {{ts '{a:%Y-%m-%d %H:%M:%S.%f}'}} and \"occurred_at\" < {{ts '{b:%Y-%m-%d %H:%M:%S.%f}'}}" for a, b in months]
    found = {}
    for name, schema in TABLES.items():
        raw = spark.read.jdbc(url, name, predicates=parts, properties=properties or {}) if name == "events" else spark.read.jdbc(url, name, properties=properties or {})
        found[name] = shaped(raw, schema)
    return Dataset(**found)


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns, cast; "", "nan", "none" and "null" in number columns become null."""
    columns = []
    for part in schema.split(", "):
        name, kind = part.split()
        value = F.col(name) if name in df.columns else F.lit(None)
        if kind not in ("string", "boolean") and name in df.columns and dict(df.dtypes)[name] == "string":
            value = F.when(~F.lower(F.trim(value)).isin("", "nan", "none", "null", "nat"), value)
            value = F.expr(f"try_cast(try_cast({name} as double) as {kind})") if kind in ("long", "int") else F.expr(f"try_cast({name} as {kind})")
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Add events, one folder a month, so that readers prune and retention drops folders."""
    events.withColumn("event_month", F.date_format("occurred_at", "yyyy-MM")).write.mode(mode).partitionBy("event_month").parquet(path)


def read_events(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Events of ``[start, end)``; the months are filtered too, so that other folders aren't listed."""
    rows = spark.read.parquet(path)
    months = F.col("event_month").between(start.strftime("%Y-%m"), end.strftime("%Y-%m"))
    return rows.filter(months & (F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end)))


def write_artefacts(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Each table under its own name in a versioned folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run_id}/{name}")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, and of each event type."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(tables["events"].groupBy(F.concat(F.lit("events."), "event_type").alias("name")).agg(F.count(F.lit(1)).alias("n_rows")))


def fingerprint(folds: DataFrame) -> DataFrame:
    """16 hex digits that stand for the folds' sizes and bounds (``fold, occurred_at, user_id, product_id``)."""
    facts = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("occurred_at")).alias("first"), F.unix_micros(F.max("occurred_at")).alias("last"), F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("items"))
    line = F.concat_ws(":", "fold", "n", "first", "last", "users", "items")
    return facts.agg(F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256), 1, 16).alias("fingerprint"))
