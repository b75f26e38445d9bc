"""The registered queries of the analytics operators, on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.session import written
from tallyrec.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that say in SQL what ``sources.adapters`` says.
SHARED = {
    "ev": """ev as (
        select event_id, ts as occurred_at, epoch_us(ts) as us,
               case event_type when 'view' then 'PRODUCT_VIEW' when 'click' then 'PRODUCT_CLICK' when 'signup' then 'ADD_TO_CART'
                    when 'purchase' then 'PURCHASE' when 'error' then 'REMOVE_FROM_CART' end as event_type,
               user_id, user_id::varchar || '-' || strftime(ts, '%Y-%m-%d') as session_key,
               cast(json_extract_string(props, '$.k') as bigint) as product_id, 'web' as source,
               case user_id % 3 when 0 then 'unknown' when 1 then 'mobile' else 'desktop' end as device_type, props as event_metadata, value
        from events)""",
    "prod": """prod as (
        select p_partkey as id, p_name as name, p_type as category_id, p_brand as brand_id, p_retailprice as price,
               case when p_retailprice < 25 then 'budget' when p_retailprice < 100 then 'mid' when p_retailprice < 400 then 'premium' else 'luxury' end as price_band,
               p_size as stock_quantity, (p_partkey % 5 + 1)::double as rating_average, p_partkey % 40 as rating_count,
               (p_partkey % 10) / 10.0 as repeat_rate, p_partkey % 17 <> 0 as is_active,
               date '2023-12-01' + (p_partkey % 50)::int as released_at
        from part)""",
    "ia": """ia as (select ev.*, prod.category_id, prod.brand_id, prod.price, prod.price_band from ev left join prod on ev.product_id = prod.id where ev.product_id is not null)""",
    "clock": """clock as (select max(us) as now_us, max(occurred_at) as now_at from ev)""",
    "items": """items as (select l_orderkey as order_id, l_partkey as product_id, l_quantity as quantity, l_extendedprice * (1 - l_discount) as line_total from lineitem)""",
    "ord": """ord as (select o_orderkey as id, o_custkey as user_id, o_totalprice as grand_total, o_orderdate as placed_at from orders)""",
    "usr": """usr as (select c_custkey as id, c_mktsegment as segment, c_nationkey::varchar as country from customer)""",
}


def register(name: str, query: Query, sql: str | None = None, needs: str = "") -> None:
    """Add a query; ``needs`` names the shared expressions its SQL starts from."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql:
        body = sql.strip()
        shared = ",\n".join(SHARED[n] for n in needs.split())
        if shared:
            body = f"with {shared},\n{body[5:]}" if body.lower().startswith("with ") else f"with {shared}\n{body}"
        ORACLES[name] = body


class Tables:
    """Lazily built domain tables of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.data = adapters.dataset(spark, sf_dir)
        self.events, self.products = self.data.events, self.data.products
        self.orders, self.items, self.users = self.data.orders, self.data.order_items, self.data.users
        self._kept = None

    @property
    def rows(self) -> DataFrame:
        return self.data.interactions() if self._kept is None else self._kept

    def keep(self) -> Tables:
        """Write the interactions once, for a query that reads them many times."""
        if self._kept is None:
            self._kept = written(self.rows, "interactions")
        return self

    @property
    def now(self):
        return adapters.last_moment(self.events)

    def raw(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.dir, name)


def on(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``columns`` rounded, so that both engines print the same."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def load() -> dict[str, Query]:
    """All queries, once the modules that register them are imported."""
    from tallyrec.plans import queries_base, queries_jobs, queries_lists, queries_reports  # noqa: F401

    return QUERIES
