"""The partitioned read from a real database, in memory."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrec.sources import io
from tallyrec.sources.schemas import TABLES

URL = "jdbc:derby:memory:shop;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
FIRST = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def database(spark):
    ends = [datetime(2024, 2, 1) - timedelta(microseconds=1), datetime(2024, 2, 1), datetime(2024, 3, 1) - timedelta(microseconds=1), datetime(2024, 3, 1), datetime(2023, 12, 31, 23, 59, 59)]
    rows = [(i, t, "PRODUCT_VIEW", 1 if i % 2 else None, f"s{i}", i, "web", "mobile", None, None) for i, t in enumerate([*ends, *[FIRST + timedelta(days=d, hours=5) for d in range(59)]])]
    for name, schema in TABLES.items():
        df = spark.createDataFrame(rows if name == "events" else [], schema)
        if name == "products":
            df = spark.createDataFrame([tuple({"id": 7, "name": "thing", "price": 9.5, "stock_quantity": 3, "is_active": True, "released_at": datetime(2024, 1, 5).date()}.get(f.name) for f in df.schema)], df.schema)
        df.write.jdbc(URL, name, mode="overwrite", properties=DRIVER)
    yield rows
    spark.sparkContext._jvm.java.lang.System.gc()


MONTHS = [(datetime(2024, 1, 1), datetime(2024, 2, 1)), (datetime(2024, 2, 1), datetime(2024, 3, 1))]


def test_months_are_partitions_with_half_open_ends(spark, database):
    events = io.read_jdbc(spark, URL, MONTHS, DRIVER).events
    assert events.rdd.getNumPartitions() == 2
    got = sorted(r.event_id for r in events.collect())
    assert got == sorted(r[0] for r in database if FIRST <= r[1] < datetime(2024, 3, 1))
    by_part = events.groupBy(F.spark_partition_id().alias("p")).agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi")).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in by_part] == [(min(r[1] for r in database if a <= r[1] < b), max(r[1] for r in database if a <= r[1] < b)) for a, b in MONTHS]


def test_types_and_nulls(spark, database):
    data = io.read_jdbc(spark, URL, MONTHS, DRIVER)
    for name, schema in TABLES.items():
        assert getattr(data, name).dtypes == spark.createDataFrame([], schema).dtypes
    assert data.events.filter("user_id is null").count() == sum(r[3] is None for r in database if FIRST <= r[1] < datetime(2024, 3, 1))
    product = data.products.first()
    assert (product.id, product.price, product.stock_quantity, product.is_active, str(product.released_at), product.sku) == (7, 9.5, 3, True, "2024-01-05", None)


def test_filters_and_columns_reach_the_database(spark, database):
    events = io.read_jdbc(spark, URL, MONTHS, DRIVER).events
    plan = events.filter("product_id = 9").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(product_id,9)" in plan
    assert "session_key" not in plan.split("ReadSchema")[1]


def test_a_missing_table_raises_when_it_is_read(spark, tmp_path):
    """Folders without a table, and databases without one."""
    for name in ("events", "products"):
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert io.read_parquet(spark, str(tmp_path), ("events", "products")).events.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        io.read_parquet(spark, str(tmp_path), ("events", "products", "orders"))
    with pytest.raises(Exception, match="(?i)does not exist"):
        io.read_jdbc(spark, "jdbc:derby:memory:empty;create=true", MONTHS, DRIVER)
