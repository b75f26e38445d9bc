"""The driver's tables in the domain's shape: an explicit stand-in that exercises the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.functions.columns import mapped
from tallyrec.sources.io import Dataset

EVENT_NAMES = {"view": "PRODUCT_VIEW", "click": "PRODUCT_CLICK", "signup": "ADD_TO_CART", "purchase": "PURCHASE", "error": "REMOVE_FROM_CART"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return raw.select(
        "event_id",
        at.alias("occurred_at"),
        mapped(F.col("event_type"), EVENT_NAMES).alias("event_type"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(at, "yyyy-MM-dd")).alias("session_key"),
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        F.lit("web").alias("source"),
        F.when(F.col("user_id") % 3 == 0, "unknown").when(F.col("user_id") % 3 == 1, "mobile").otherwise("desktop").alias("device_type"),
        F.col("props").alias("event_metadata"),
        "value",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue.  Stock, ratings and repeat rates have no source, so they are rules on the key."""
    part = table(spark, sf_dir, "part")
    price = F.col("p_retailprice")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category_id"),
        F.col("p_brand").alias("brand_id"),
        price.alias("price"),
        F.when(price < 25, "budget").when(price < 100, "mid").when(price < 400, "premium").otherwise("luxury").alias("price_band"),
        F.col("p_size").cast("int").alias("stock_quantity"),
        (F.col("p_partkey") % 5 + 1).cast("double").alias("rating_average"),
        (F.col("p_partkey") % 40).alias("rating_count"),
        ((F.col("p_partkey") % 10) / 10.0).alias("repeat_rate"),
        (F.col("p_partkey") % 17 != 0).alias("is_active"),
        F.date_add(F.lit("2023-12-01").cast("date"), (F.col("p_partkey") % 50).cast("int")).alias("released_at"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders")
    return raw.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("grand_total"), F.col("o_orderdate").cast("timestamp").alias("placed_at"), F.col("o_orderstatus").alias("status"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem")
    return raw.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_total"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer")
    return raw.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("country"))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(events=events(spark, sf_dir), products=products(spark, sf_dir), orders=orders(spark, sf_dir), order_items=order_items(spark, sf_dir), users=users(spark, sf_dir))


def last_moment(rows: DataFrame, column: str = "occurred_at") -> Column:
    """The latest time in ``rows`` as a literal: the clock of all queries (one row comes to the driver)."""
    micros = rows.agg(F.unix_micros(F.max(column))).first()[0]
    return F.timestamp_micros(F.lit(micros).cast("long"))
