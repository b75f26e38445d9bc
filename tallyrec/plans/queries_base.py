"""Queries of loading, validation, splitting, weighting and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrec.config import TREND_WEIGHTS
from tallyrec.operators import asof, counters, features, popularity, split, validation, weighting
from tallyrec.plans.registry import Tables, on, register, rounded
from tallyrec.sources import io

WEIGHTS = {"PRODUCT_VIEW": 1.0, "PRODUCT_CLICK": 1.5, "ADD_TO_CART": 5.0, "PURCHASE": 10.0, "REMOVE_FROM_CART": -1.5}
WEIGHT_SQL = "case event_type when 'PRODUCT_VIEW' then 1.0::double when 'PRODUCT_CLICK' then 1.5 when 'ADD_TO_CART' then 5.0 when 'PURCHASE' then 10.0 when 'REMOVE_FROM_CART' then -1.5 else 1.0 end"
TREND_SQL = "case event_type when 'PRODUCT_VIEW' then 1.0::double when 'PRODUCT_CLICK' then 1.5 when 'WISHLIST' then 3.0 when 'ADD_TO_CART' then 5.0 when 'PURCHASE' then 12.0 else 0.0 end"
MATRIX_SQL = f"""mx as (
    select user_id, product_id, least(greatest(sum({WEIGHT_SQL} * pow(0.5, greatest((now_us - us) / 86400e6, 0) / 45.0)), 0.0), 60.0) as weight,
           min(us) as first_us, max(us) as last_us, count(*) as n_events
    from ia, clock group by all having weight > 0)"""


def matrix(t: Tables):
    return weighting.interaction_matrix(t.rows, WEIGHTS, t.now)


def matrix_out(t: Tables):
    return rounded(matrix(t), "weight").select("user_id", "product_id", "weight", F.unix_micros("first_interaction_at").alias("first_us"), F.unix_micros("last_interaction_at").alias("last_us"), "n_events")


# A. loading
register("a4_interactions", on(lambda t: t.rows.select("user_id", "product_id", "event_type", F.unix_micros("occurred_at").alias("us"), "category_id", "brand_id", "price", "price_band")), "select user_id, product_id, event_type, us, category_id, brand_id, price, price_band from ia", "ev prod ia")
register("a2_decode_json", on(lambda t: io.decode_json(t.events, "events").select("event_id", F.col("event_metadata")["k"].alias("k"), F.size("event_metadata").alias("n_keys"))), "select event_id, json_extract_string(props, '$.k') as k, len(json_keys(props))::int as n_keys from events")
register("a5_time_span", on(lambda t: io.time_span(t.events)), "select min(us) as first_us, max(us) as last_us, count(*) as n_events from ev", "ev")
register("a6_diagnostic_rows", on(lambda t: t.rows.filter(F.col("event_type").isin("PRODUCT_VIEW", "PRODUCT_CLICK", "ADD_TO_CART", "WISHLIST", "PURCHASE")).groupBy("category_id", "brand_id", "event_type").agg(F.count(F.lit(1)).alias("n"))), "select category_id, brand_id, event_type, count(*) as n from ia where event_type <> 'REMOVE_FROM_CART' group by all", "ev prod ia")
register("a8_month_partitions", on(lambda t: t.events.groupBy(F.date_format("occurred_at", "yyyy-MM").alias("event_month")).agg(F.count(F.lit(1)).alias("n"))), "select strftime(occurred_at, '%Y-%m') as event_month, count(*) as n from ev group by all", "ev")
register("a11_typed_load", on(lambda t: io.shaped(t.raw("events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("user_id") % 5 == 0, "nan").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("user_id"), "event_type"), "id long, user_id long, event_type string, missing int")), "select event_id as id, case when user_id % 5 <> 0 then user_id end as user_id, event_type, null::int as missing from events")
register("a12_manifest", on(lambda t: io.manifest({"events": t.events, "products": t.products, "orders": t.orders})), "select 'events' as name, count(*) as n_rows from ev union all select 'products', count(*) from part union all select 'orders', count(*) from orders union all select 'events.' || event_type, count(*) from ev group by event_type", "ev")
register(
    "a14_product_counters",
    on(lambda t: rounded(t.products.select("id", "rating_average", "rating_count").join(t.rows.groupBy(F.col("product_id").alias("id")).agg(F.sum((F.col("event_type") == "PRODUCT_VIEW").cast("long")).alias("views"), F.sum((F.col("event_type") == "PURCHASE").cast("long")).alias("purchases")), "id", "left").fillna(0).withColumn("shrunk_rating", (F.col("rating_average") * F.col("rating_count") + 12 * 3.0) / (F.col("rating_count") + 12)).select("id", "views", "purchases", "shrunk_rating"), "shrunk_rating", digits=2)),
    "select id, coalesce(views, 0) as views, coalesce(purchases, 0) as purchases, round((rating_average * rating_count + 12 * 3.0) / (rating_count + 12), 2) as shrunk_rating from prod left join (select product_id, count(*) filter (event_type = 'PRODUCT_VIEW') as views, count(*) filter (event_type = 'PURCHASE') as purchases from ia group by 1) c on prod.id = c.product_id",
    "ev prod ia",
)
register(
    "a15_user_product_rollup",
    on(lambda t: t.rows.groupBy("user_id", "product_id").agg(*[F.sum((F.col("event_type") == k).cast("long")).alias(n) for k, n in (("PRODUCT_VIEW", "views"), ("PRODUCT_CLICK", "clicks"), ("ADD_TO_CART", "carts"), ("PURCHASE", "purchases"))], F.round(F.sum(F.when(F.col("event_type") == "PURCHASE", F.col("price")).otherwise(0.0)), 4).alias("spend"), F.unix_micros(F.min("occurred_at")).alias("first_us"), F.unix_micros(F.max("occurred_at")).alias("last_us"))),
    "select user_id, product_id, count(*) filter (event_type = 'PRODUCT_VIEW') as views, count(*) filter (event_type = 'PRODUCT_CLICK') as clicks, count(*) filter (event_type = 'ADD_TO_CART') as carts, count(*) filter (event_type = 'PURCHASE') as purchases, round(sum(case when event_type = 'PURCHASE' then coalesce(price, 0) else 0.0 end), 4) as spend, min(us) as first_us, max(us) as last_us from ia group by all",
    "ev prod ia",
)

# B. validation and counters
#: The driver's events carry one key, so these stand for the payload rules.
TEST_RULES = {kind: {"k": ("int", 0, 89)} for kind in WEIGHTS}


def validated(t: Tables):
    odd = t.events.withColumn("session_key", F.when(F.col("event_id") % 11 == 0, "short").otherwise(F.col("session_key"))).withColumn("product_id", F.when(F.col("event_id") % 13 != 0, F.col("product_id"))).withColumn("event_type", F.when(F.col("event_id") % 29 == 0, "SEARCH").otherwise(F.col("event_type"))).withColumn("session_key", F.when(F.length("session_key") < 8, F.col("session_key")).otherwise(F.rpad("session_key", 12, "x")))
    return validation.validate(odd, t.now, TEST_RULES)


ODD_SQL = """odd as (
    select event_id, us, case when event_id % 29 = 0 then 'SEARCH' else event_type end as event_type,
           case when event_id % 11 = 0 then 'short' else rpad(session_key, 12, 'x') end as session_key,
           case when event_id % 13 <> 0 then product_id end as product_id, cast(json_extract_string(event_metadata, '$.k') as int) as k
    from ev),
judged as (
    select event_id, us, list_filter([
        case when length(session_key) not between 8 and 64 then 'bad_session_key' end,
        case when product_id <= 0 then 'bad_product_id' end,
        case when us < now_us - 7 * 86400000000 then 'too_old' end,
        case when event_type <> 'SEARCH' and product_id is null then 'missing_product' end,
        case when event_type = 'SEARCH' and product_id is not null then 'needless_product' end,
        case when event_type <> 'SEARCH' and k not between 0 and 89 then 'bad_k' end
    ], lambda x : x is not null) as reasons
    from odd, clock)"""
register("b1_validate", on(lambda t: validated(t).select("event_id", F.array_join("reasons", ",").alias("reasons"))), f"with {ODD_SQL} select event_id, array_to_string(reasons, ',') as reasons from judged", "ev clock")
register("b2_reason_counts", on(lambda t: validation.reason_counts(validated(t))), f"with {ODD_SQL} select reason, count(*) as n from (select unnest(reasons) as reason from judged) group by all", "ev clock")
register("b3_bounded_time", on(lambda t: validation.validate(t.events.withColumn("occurred_at", F.when(F.col("event_id") % 7 == 0, F.col("occurred_at") + F.expr("interval 40 days")).when(F.col("event_id") % 7 != 1, F.col("occurred_at"))), t.now, TEST_RULES).select("event_id", F.unix_micros("occurred_at").alias("us"))), "select event_id, case event_id % 7 when 0 then case when us + 40 * 86400000000 > now_us + 300000000 then now_us else us + 40 * 86400000000 end when 1 then now_us else us end as us from ev, clock", "ev clock")
register("b5_attribute_users", on(lambda t: validation.attribute_users(t.events.select("event_id", "session_key", F.lit(-1).alias("user_id")), t.events.filter("event_id % 3 = 0").select("session_key", "user_id")).select("event_id", "user_id")), "with p as (select session_key, min(user_id) as user_id from ev where event_id % 3 = 0 group by 1) select event_id, p.user_id from ev left join p using (session_key)", "ev")
register("b6_accounting", on(lambda t: validation.accounting(validated(t).withColumn("batch", F.floor(F.col("event_id") / 100)), ["batch"])), f"with {ODD_SQL} select event_id // 100 as batch, count(*) filter (len(reasons) = 0) as accepted, count(*) filter (len(reasons) > 0) as rejected from judged group by all", "ev clock")
BUCKET_SQL = f"bk as (select epoch_us(date_trunc('hour', occurred_at)) as bucket_us, product_id, sum({TREND_SQL}) as score from ev where product_id is not null and {TREND_SQL} > 0 group by all)"
register("b7_hourly_buckets", on(lambda t: rounded(counters.hourly_buckets(t.events).select(F.unix_micros("bucket_start").alias("bucket_us"), "product_id", "score"), "score")), f"with {BUCKET_SQL} select bucket_us, product_id, round(score, 6) as score from bk", "ev")
register(
    "b8_category_buckets",
    on(lambda t: rounded(counters.hourly_buckets(t.events, t.products.select(F.col("id").alias("product_id"), "category_id")).filter("scope <> 'all'").groupBy(F.unix_micros("bucket_start").alias("bucket_us"), "scope").agg(F.sum("score").alias("score")), "score")),
    f"with {BUCKET_SQL} select bucket_us, category_id as scope, round(sum(score), 6) as score from bk join prod on bk.product_id = prod.id group by all",
    "ev prod",
)
LIVE_SQL = "lv as (select product_id, score * pow(0.5, age / 6.0) as s from (select *, (epoch_us(date_trunc('hour', now_at)) - bucket_us) / 3600000000 as age from bk, clock) where age >= 0 and age < 24)"
register("b9_live_trending", on(lambda t: rounded(counters.live_trending(counters.hourly_buckets(t.events), t.now, 20), "score").select("product_id", "score")), f"with {BUCKET_SQL}, {LIVE_SQL} select product_id, round(sum(s), 6) as score from lv group by 1 order by sum(s) desc, product_id limit 20", "ev clock")
register("b10_session_products", on(lambda t: counters.session_products(t.events)), "select session_key, product_id, rank from (select session_key, product_id, row_number() over (partition by session_key order by occurred_at desc, event_id desc)::int as rank from ev where event_type in ('PRODUCT_VIEW', 'PRODUCT_CLICK') and product_id is not null) where rank <= 50", "ev")
register("b11_recently_viewed", on(lambda t: counters.recently_viewed(t.events)), "with l as (select user_id, product_id, max(struct_pack(a := us, b := event_id)) as last from ev where event_type = 'PRODUCT_VIEW' and product_id is not null group by all) select user_id, product_id, rank from (select *, row_number() over (partition by user_id order by last desc)::int as rank from l) where rank <= 50", "ev")
SESSION_SQL = "se as (select session_key, min(user_id) as user_id, coalesce(arg_min(device_type, struct_pack(a := us, b := event_id)) filter (device_type <> 'unknown'), 'unknown') as device_type, min(us) as started_us, max(us) as ended_us, count(*) as event_count, bool_or(event_type = 'PURCHASE') as converted from ev group by 1)"
shown = lambda df: df.select("session_key", "user_id", "device_type", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "event_count", "converted")
register("b12_sessions", on(lambda t: shown(counters.roll_up_sessions(t.events))), f"with {SESSION_SQL} select * from se", "ev")
register("b13_merge_sessions", on(lambda t: shown(counters.merge_sessions(counters.roll_up_sessions(t.events.filter("event_id % 2 = 0")), counters.roll_up_sessions(t.events.filter("event_id % 2 = 1"))))), f"with {SESSION_SQL} select * from se", "ev")
register("b14_stitch", on(lambda t: counters.stitch(t.events.withColumn("user_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id"))), counters.roll_up_sessions(t.events)).select("event_id", "user_id")), "select event_id, user_id from ev", "ev")
register("b15_refresh_users", on(lambda t: validation.high_signal_users(t.events)), "select user_id, max(us) as last_us from ev where event_type in ('PURCHASE', 'ADD_TO_CART') and user_id is not null group by 1", "ev")
register(
    "b16_warm_buckets",
    on(lambda t: rounded(counters.warm_buckets(counters.hourly_buckets(t.events), t.products.select(F.lit("all").alias("scope"), F.col("id").alias("product_id"), F.lit(0.5).alias("score")), t.now).groupBy("product_id").agg(F.sum("score").alias("score")), "score")),
    f"with {BUCKET_SQL} select product_id, round(sum(score), 6) as score from (select product_id, score from bk union all select id, 0.5 from prod) group by all",
    "ev prod",
)
register("b17_feedback", on(lambda t: _feedback(t)), "select case event_type when 'PRODUCT_VIEW' then 'impression' else 'click' end as kind, product_id, count(*) as n from ev where event_id % 3 = 0 and event_type in ('PRODUCT_VIEW', 'PRODUCT_CLICK') group by all", "ev")
register("b19_deduplicate", on(lambda t: counters.deduplicate(t.events.unionByName(t.events.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 1 hour")))).select("event_id", F.unix_micros("occurred_at").alias("us"))), "select event_id, us from ev", "ev")
register("b20_over_limit", on(lambda t: counters.over_limit(t.events, 1)), "select epoch_us(date_trunc('minute', occurred_at)) as minute_us, user_id, count(*) as n from ev group by all having count(*) > 1", "ev")


def _feedback(t: Tables):
    a, b = counters.split_feedback(t.events.withColumn("recommendation_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id"))))
    both = a.withColumn("kind", F.lit("impression")).unionByName(b.withColumn("kind", F.lit("click")))
    return both.groupBy("kind", "product_id").agg(F.count(F.lit(1)).alias("n"))


# D. split
FOLD_SQL = """ranked as (select *, row_number() over (order by us) - 1 as pos, count(*) over () as n from ia),
cuts as (select max(us) filter (pos = round_even((n - 1) * 0.7::double, 0)) as t1, max(us) filter (pos = round_even((n - 1) * (0.7::double + 0.15::double), 0)) as t2 from ranked),
folds as (select ia.*, case when us < t1 then 'train' when us < t2 then 'validation' else 'test' end as fold from ia, cuts)"""
folds = lambda t: split.split_temporal(t.rows, times=t.events.filter("product_id is not null"))
register("d1_split", on(lambda t: split.fold_summary(folds(t))), f"with {FOLD_SQL} select fold, count(*) as n_rows, count(distinct user_id) as users, count(distinct product_id) as items, min(us) as first_us, max(us) as last_us from folds group by all", "ev prod ia")
register("d2_fold_order", on(lambda t: split.fold_order(folds(t))), f"with {FOLD_SQL}, b as (select fold, min(us) as lo, max(us) as hi from folds group by 1) select a.fold, n.fold as next_fold, a.hi < n.lo as in_order from b a join b n on (a.fold, n.fold) in (('train', 'validation'), ('validation', 'test'))", "ev prod ia")
register("d3_rows_after", on(lambda t: split.rows_after(folds(t).filter("fold <> 'test'"), t.now)), f"with {FOLD_SQL} select count(*) as n from folds, (select max(us) as now_us from ev) where fold <> 'test' and us >= now_us", "ev prod ia")
register("d4_targets", on(lambda t: split.targets(folds(t), "test")), f"with {FOLD_SQL} select distinct user_id, product_id from folds where fold = 'test' and event_type in ('PURCHASE', 'ADD_TO_CART', 'PRODUCT_CLICK')", "ev prod ia")
register("d5_eligible_users", on(lambda t: split.eligible_users(folds(t), "test", 40)), f"with {FOLD_SQL} select distinct user_id from folds where fold = 'test' and user_id in (select user_id from folds where fold = 'train' group by 1 having count(*) >= 40)", "ev prod ia")
register("a13_fingerprint", on(lambda t: io.fingerprint(folds(t))), f"with {FOLD_SQL}, f as (select concat_ws(':', fold, count(*), min(us), max(us), count(distinct user_id), count(distinct product_id)) as line from folds group by fold) select substr(sha256(string_agg(line, '|' order by line)), 1, 16) as fingerprint from f", "ev prod ia")

# E. weighting
CONVERT_SQL = "fp as (select user_id, product_id, min(us) as bought_us from ia where event_type = 'PURCHASE' group by all), cv as (select ia.*, coalesce(abs(bought_us - us) <= 30 * 86400000000, false) as converted from ia left join fp using (user_id, product_id))"
register("e1_first_purchases", on(lambda t: weighting.first_purchases(t.rows).select("user_id", "product_id", F.unix_micros("purchased_at").alias("bought_us"))), f"with {CONVERT_SQL} select * from fp", "ev prod ia")
register("e2_conversion_rates", on(lambda t: rounded(weighting.conversion_rates(t.rows), "rate")), f"with {CONVERT_SQL} select event_type, count(*) as support, round(avg(converted::int), 6) as rate from cv group by all", "ev prod ia")
register("e3_base_rate", on(lambda t: rounded(weighting.base_rate(t.rows), "base_rate")), "select round(avg(b), 6) as base_rate from (select max((event_type = 'PURCHASE')::int) as b from ia group by user_id, product_id)", "ev prod ia")
register(
    "e4_calibrated_weights",
    on(lambda t: rounded(weighting.report(t.spark, weighting.calibrate(t.rows)), "rate", "lift", "weight")),
    f"""with {CONVERT_SQL}, b as (select avg(x) as base from (select max((event_type = 'PURCHASE')::int) as x from ia group by user_id, product_id)),
    r as (select event_type, count(*) as support, avg(converted::int) as rate from cv group by 1),
    w as (select event_type, support, rate, rate / base as lift, case when support >= 200 then ln(1 + rate / base) else case event_type when 'PRODUCT_VIEW' then 1.0 when 'PRODUCT_CLICK' then 1.5 when 'ADD_TO_CART' then 5.0 when 'REMOVE_FROM_CART' then -1.5 end end as raw from r, b),
    m as (select 1.6 * max(raw) filter (raw > 0 and event_type not in ('PURCHASE', 'REMOVE_FROM_CART')) as anchor, max(raw) filter (event_type = 'PRODUCT_VIEW') as unit from w)
    select event_type, support, round(rate, 6) as rate, round(lift, 6) as lift, round((case event_type when 'PURCHASE' then anchor when 'REMOVE_FROM_CART' then -abs(raw) else raw end) / unit, 6) as weight from w, m""",
    "ev prod ia",
)
register("e10_interaction_matrix", on(matrix_out), f"with {MATRIX_SQL} select user_id, product_id, round(weight, 6) as weight, first_us, last_us, n_events from mx", "ev prod ia clock")
register("e11_event_type_counts", on(lambda t: weighting.event_type_counts(t.rows)), "select event_type, count(*) as n from ia group by 1", "ev prod ia")

# F. features
PCT_SQL = "pc as (select id, (rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0) / count(*) over () as pct from prod)"
USER_SQL = f"""{PCT_SQL},
hr as (select user_id, sum(n * n) / pow(sum(n), 2) as h from (select user_id, category_id, count(*)::double as n from pre where category_id is not null group by all) group by 1),
br as (select user_id, sum(n * n) / pow(sum(n), 2) as h from (select user_id, brand_id, count(*)::double as n from pre where brand_id is not null group by all) group by 1),
ov as (select user_id, avg(grand_total) as aov from ord, clock where placed_at < now_at group by 1),
b as (
    select pre.user_id, count(*) as total_events, count(*) filter (event_type = 'PRODUCT_VIEW') as total_views, count(*) filter (event_type = 'PRODUCT_CLICK') as total_clicks,
        count(*) filter (event_type = 'ADD_TO_CART') as total_carts, count(*) filter (event_type = 'PURCHASE') as total_purchases,
        count(distinct product_id) filter (event_type = 'PRODUCT_VIEW') as distinct_products_viewed, count(distinct category_id) as distinct_categories, count(distinct brand_id) as distinct_brands,
        count(distinct session_key) as session_count, count(distinct us // 86400000000) as active_days, coalesce(sum(price) filter (event_type = 'PURCHASE'), 0) as total_spending,
        avg(price) filter (event_type = 'PURCHASE') as avg_purchase_price, quantile_cont(price, 0.5) filter (event_type = 'PURCHASE') as median_purchase_price,
        avg(pct) filter (event_type = 'PURCHASE') as price_percentile_mean, (any_value(now_us) - max(us)) / 86400e6 as days_since_last_event, (any_value(now_us) - min(us)) / 86400e6 as days_since_first_seen,
        (any_value(now_us) - max(us) filter (event_type = 'PURCHASE')) / 86400e6 as sp, (max(us) filter (event_type = 'PURCHASE') - min(us) filter (event_type = 'PURCHASE')) / 86400e6 as span
    from pre left join pc on pre.product_id = pc.id, clock group by 1)"""
PRE_SQL = "pre as (select ia.* from ia, clock where us < now_us)"
user_table = lambda t: features.user_features(t.rows, t.products, t.now, t.orders)
register("f1_user_activity", on(lambda t: user_table(t).select("user_id", *features.USER_FEATURES[:10])), f"with {PRE_SQL}, {USER_SQL} select user_id, total_events, total_views, total_clicks, total_carts, total_purchases, distinct_products_viewed, distinct_categories, distinct_brands, session_count, active_days from b", "ev prod ia clock ord")
register(
    "f3_user_spending",
    on(lambda t: rounded(user_table(t).select("user_id", "total_spending", "avg_purchase_price", "median_purchase_price", "avg_order_value", "price_percentile_mean", "price_sensitivity"), "total_spending", "avg_purchase_price", "median_purchase_price", "avg_order_value", "price_percentile_mean", "price_sensitivity", digits=8)),
    f"with {PRE_SQL}, {USER_SQL} select user_id, round(total_spending, 8) as total_spending, round(coalesce(avg_purchase_price, 0), 8) as avg_purchase_price, round(coalesce(median_purchase_price, 0), 8) as median_purchase_price, round(coalesce(aov, total_spending), 8) as avg_order_value, round(coalesce(price_percentile_mean, 0), 8) as price_percentile_mean, round(case when total_purchases > 0 then coalesce(least(greatest(1 - price_percentile_mean, 0), 1), 0) else 0.5 end, 8) as price_sensitivity from b left join ov using (user_id)",
    "ev prod ia clock ord",
)
register(
    "f6_user_rhythm",
    on(lambda t: rounded(user_table(t).select("user_id", *features.USER_FEATURES[16:]), *features.USER_FEATURES[16:], digits=4)),
    f"""with {PRE_SQL}, {USER_SQL} select b.user_id, round(coalesce(total_carts / nullif(total_views, 0), 0), 4) as view_to_cart_rate, round(coalesce(total_purchases / nullif(total_carts, 0), 0), 4) as cart_to_purchase_rate, round(coalesce(total_purchases / nullif(total_views, 0), 0), 4) as view_to_purchase_rate,
    round(days_since_last_event, 4) as days_since_last_event, round(days_since_first_seen, 4) as days_since_first_seen, round(coalesce(sp, days_since_first_seen), 4) as days_since_last_purchase,
    round(case when total_purchases > 1 then span / (total_purchases - 1) else days_since_first_seen end, 4) as purchase_frequency_days, round(total_events / active_days, 4) as events_per_active_day,
    round(coalesce(hr.h, 0), 4) as category_concentration, round(coalesce(br.h, 0), 4) as brand_concentration,
    round(total_spending + total_spending / greatest(days_since_first_seen, 1) * 365 * exp(-coalesce(sp, days_since_first_seen) / 90), 4) as customer_lifetime_value from b left join hr using (user_id) left join br using (user_id)""",
    "ev prod ia clock ord",
)
register("f13_all_users", on(lambda t: features.user_features(t.rows, t.products, t.now, t.orders, t.users).select("user_id", "total_events", "price_sensitivity").filter("total_events = 0")), f"with {PRE_SQL} select id as user_id, 0::bigint as total_events, 0.5::double as price_sensitivity from usr where id not in (select user_id from pre)", "ev prod ia clock usr")
AFF_SQL = "af as (select user_id, key_id, weight / sum(weight) over (partition by user_id) as affinity, rank from (select *, row_number() over (partition by user_id order by weight desc, key_id)::int as rank from (select user_id, {level} as key_id, sum(weight) as weight from mx join prod on mx.product_id = prod.id group by all)) where rank <= {n})"
for letter, level, n in (("category", "category_id", 10), ("brand", "brand_id", 6)):
    register(f"f15_{letter}_affinity", on(lambda t, level=level, n=n: rounded(features.affinity(t.rows, matrix(t), t.products, level, n), "affinity")), f"with {MATRIX_SQL}, {AFF_SQL.format(level=level, n=n)} select user_id, key_id, round(affinity, 6) as affinity, rank from af", "ev prod ia clock")
PRODUCT_SQL = f"""c as (select product_id, count(*) filter (event_type = 'PRODUCT_VIEW') as view_count_total, count(*) filter (event_type = 'PRODUCT_VIEW' and (now_us - us) <= 30 * 86400e6) as view_count_30d, count(*) filter (event_type = 'PRODUCT_VIEW' and (now_us - us) <= 7 * 86400e6) as view_count_7d,
    count(*) filter (event_type = 'ADD_TO_CART' and (now_us - us) <= 30 * 86400e6) as cart_count_30d, count(*) filter (event_type = 'PURCHASE') as purchase_count_total, count(*) filter (event_type = 'PURCHASE' and (now_us - us) <= 30 * 86400e6) as purchase_count_30d from pre, clock group by 1),
buy as (select product_id, count(*) as distinct_buyers, avg((n > 1)::int) as repeat_purchase_rate from (select product_id, user_id, count(*) as n from pre where event_type = 'PURCHASE' group by all) group by 1),
tr as (select product_id, sum({TREND_SQL} * pow(0.5, (now_us - us) / 3600e6 / 42.0)) as ts from pre, clock where (now_us - us) / 3600e6 <= 168 group by 1),
p as (select prod.id as product_id, prod.price, category_id, rating_average, rating_count, greatest((now_us - epoch_us(released_at::timestamp)) / 86400e6, 0) as days_since_release,
    (rank() over (partition by category_id order by price) + (count(*) over (partition by category_id, price) - 1) / 2.0) / count(*) over (partition by category_id) as price_percentile,
    coalesce(view_count_total, 0) as vt, coalesce(view_count_30d, 0) as v30, coalesce(view_count_7d, 0) as v7, coalesce(cart_count_30d, 0) as c30, coalesce(purchase_count_total, 0) as pt, coalesce(purchase_count_30d, 0) as p30, coalesce(distinct_buyers, 0) as distinct_buyers, coalesce(repeat_purchase_rate, 0) as rpr, coalesce(ts, 0) as ts
    from prod cross join clock left join c on c.product_id = prod.id left join buy on buy.product_id = prod.id left join tr on tr.product_id = prod.id),
g as (select sum(v30) as gv, sum(c30) as gc, sum(p30) as gp, avg(rating_average) filter (rating_count > 0) as gr from p),
q as (select p.*, p.price * p30 as rev, (p30 + 20 * gp / gv) / (v30 + 20) as conversion_rate, (c30 + 20 * gc / gv) / (v30 + 20) as view_to_cart_rate, (rating_average * rating_count + gr * 20) / (rating_count + 20) as quality_score, 0.55 * ln(1 + pt) + 0.25 * ln(1 + vt) + 0.20 * ln(1 + p.price * p30) as pop, -ln(1 + vt + pt) as nov from p, g)"""
product_table = lambda t: features.product_features(t.rows, t.products, t.now)
register("f16_product_counts", on(lambda t: rounded(product_table(t).select("product_id", "price_percentile", "days_since_release", "view_count_total", "view_count_30d", "view_count_7d", "cart_count_30d", "purchase_count_total", "purchase_count_30d", "distinct_buyers", "repeat_purchase_rate", "is_cold"), "price_percentile", "days_since_release", "repeat_purchase_rate", digits=4)), f"with {PRE_SQL}, {PRODUCT_SQL} select product_id, round(price_percentile, 4) as price_percentile, round(days_since_release, 4) as days_since_release, vt as view_count_total, v30 as view_count_30d, v7 as view_count_7d, c30 as cart_count_30d, pt as purchase_count_total, p30 as purchase_count_30d, distinct_buyers, round(rpr, 4) as repeat_purchase_rate, (vt + pt < 5)::int as is_cold from q", "ev prod ia clock")
register(
    "f20_product_scores",
    on(lambda t: rounded(product_table(t).select("product_id", "revenue_30d", "conversion_rate", "view_to_cart_rate", "quality_score", "popularity_score", "trending_score", "novelty_score"), "revenue_30d", "conversion_rate", "view_to_cart_rate", "quality_score", "popularity_score", "trending_score", "novelty_score")),
    f"""with {PRE_SQL}, {PRODUCT_SQL} select product_id, round(rev, 6) as revenue_30d, round(conversion_rate, 6) as conversion_rate, round(view_to_cart_rate, 6) as view_to_cart_rate, round(quality_score, 6) as quality_score,
    round((pop - min(pop) over ()) / (max(pop) over () - min(pop) over ()), 6) as popularity_score, round((ts - min(ts) over ()) / (max(ts) over () - min(ts) over ()), 6) as trending_score, round((nov - min(nov) over ()) / (max(nov) over () - min(nov) over ()), 6) as novelty_score from q""",
    "ev prod ia clock",
)
#: Days on which a user bought: the training rows, each with what was known before that day.
TRAINED_SQL = "tr as (select distinct user_id, us // 86400000000 as day from ia where event_type = 'PURCHASE' and user_id is not null)"


def trained(t: Tables):
    return t.rows.filter("event_type = 'PURCHASE' and user_id is not null").select("user_id", asof.day_of("occurred_at").alias("day")).distinct()


AT_USER = ["total_spending", "avg_purchase_price", "median_purchase_price", "price_percentile_mean", "avg_order_value", "days_since_last_event", "days_since_first_seen", "category_concentration", "brand_concentration", "events_per_active_day", "view_to_purchase_rate"]
AT_COUNTS = ["total_events", "total_views", "total_clicks", "total_carts", "total_purchases", "distinct_products_viewed", "distinct_categories", "distinct_brands", "session_count", "active_days"]
register(
    "f1_user_features_asof",
    on(lambda t: rounded(asof.user_features_at(asof.user_days(t.rows, t.products), trained(t), t.orders).select("user_id", "day", *[F.col(c).cast("long").alias(c) for c in AT_COUNTS], *AT_USER), *AT_USER, digits=8)),
    f"""with {TRAINED_SQL},
    pc as (select price, (sum(n) over (order by price rows unbounded preceding) - n + (n + 1) / 2.0) / sum(n) over () as pct from (select price, count(*) as n from prod where price is not null group by 1)),
    j as (select tr.user_id, tr.day, ia.us, ia.event_type, ia.product_id, ia.category_id, ia.brand_id, ia.session_key, case when event_type = 'PURCHASE' then ia.price end as paid, case when event_type = 'PURCHASE' then pc.pct end as pct from tr left join ia on ia.user_id = tr.user_id and ia.us < tr.day * 86400000000 left join pc on pc.price = ia.price),
    hc as (select user_id, day, sum(n * n) / pow(sum(n), 2) as h from (select user_id, day, category_id, count(*)::double as n from j where category_id is not null group by all) group by all),
    hb as (select user_id, day, sum(n * n) / pow(sum(n), 2) as h from (select user_id, day, brand_id, count(*)::double as n from j where brand_id is not null group by all) group by all),
    od as (select tr.user_id, tr.day, avg(grand_total) as v from tr join ord on ord.user_id = tr.user_id and epoch_us(placed_at::timestamp) < tr.day * 86400000000 group by all),
    g as (select user_id, day, count(us) as total_events, count(*) filter (event_type = 'PRODUCT_VIEW') as total_views, count(*) filter (event_type = 'PRODUCT_CLICK') as total_clicks, count(*) filter (event_type = 'ADD_TO_CART') as total_carts, count(*) filter (event_type = 'PURCHASE') as total_purchases,
        count(distinct case when event_type = 'PRODUCT_VIEW' then product_id end) as distinct_products_viewed, count(distinct category_id) as distinct_categories, count(distinct brand_id) as distinct_brands, count(distinct session_key) as session_count, count(distinct us // 86400000000) as active_days,
        coalesce(sum(paid), 0) as spent, avg(paid) as ap, median(paid) as mp, avg(pct) as pp, max(us) as last_us, min(us) as first_us from j group by all)
    select user_id, day::int as day, total_events, total_views, total_clicks, total_carts, total_purchases, distinct_products_viewed, distinct_categories, distinct_brands, session_count, active_days, round(spent, 8) as total_spending, round(coalesce(ap, 0), 8) as avg_purchase_price, round(coalesce(mp, 0), 8) as median_purchase_price, round(coalesce(pp, 0), 8) as price_percentile_mean,
        round(case when total_events > 0 then coalesce(od.v, spent) else spent end, 8) as avg_order_value, round(coalesce((day * 86400000000 - last_us) / 86400e6, 0), 8) as days_since_last_event, round(coalesce((day * 86400000000 - first_us) / 86400e6, 0), 8) as days_since_first_seen, round(coalesce(hc.h, 0), 8) as category_concentration, round(coalesce(hb.h, 0), 8) as brand_concentration,
        round(case when active_days > 0 then total_events / active_days else 0 end, 8) as events_per_active_day, round(case when total_views > 0 then total_purchases / total_views else 0 end, 8) as view_to_purchase_rate
    from g left join hc using (user_id, day) left join hb using (user_id, day) left join od using (user_id, day)""",
    "ev prod ia ord",
)


def last_days(t: Tables, n: int = 10) -> list[int]:
    """The last ``n`` days of the events."""
    last = t.rows.agg(F.max(asof.day_of("occurred_at"))).first()[0]
    return list(range(last - n + 1, last + 1)) if last is not None else []


AT_PRODUCT = ["view_count_total", "view_count_30d", "view_count_7d", "cart_count_30d", "purchase_count_total", "purchase_count_30d", "distinct_buyers"]
register(
    "f16_product_features_asof",
    on(lambda t: rounded(asof.product_features_at(asof.product_days(t.keep().rows), t.products, last_days(t)).select("product_id", "day", *[F.col(c).cast("long").alias(c) for c in AT_PRODUCT], "repeat_purchase_rate", "trending_score", "conversion_rate"), "repeat_purchase_rate", "trending_score", "conversion_rate", digits=5)),
    f"""with dy as (select (max(us) // 86400000000)::int - i as day from ia, range(10) r(i) group by i),
    j as (select product_id, day, us, event_type, user_id, day - us // 86400000000 as back, day * 86400000000 - us as behind from ia, dy where us < day * 86400000000),
    c as (select product_id, day, count(*) filter (event_type = 'PRODUCT_VIEW') as v, count(*) filter (event_type = 'PRODUCT_VIEW' and back <= 30) as v30, count(*) filter (event_type = 'PRODUCT_VIEW' and back <= 7) as v7, count(*) filter (event_type = 'ADD_TO_CART' and back <= 30) as c30, count(*) filter (event_type = 'PURCHASE') as b, count(*) filter (event_type = 'PURCHASE' and back <= 30) as b30,
        sum(case when back <= 7 then {TREND_SQL} * pow(0.5, behind / 3600e6 / 42.0) end) as ts from j group by all),
    u as (select product_id, day, count(*) as buyers, avg((n > 1)::int) as repeats from (select product_id, day, user_id, count(*) as n from j where event_type = 'PURCHASE' and user_id is not null group by all) group by all),
    q as (select prod.id as product_id, dy.day, coalesce(v, 0) as v, coalesce(v30, 0) as v30, coalesce(v7, 0) as v7, coalesce(c30, 0) as c30, coalesce(b, 0) as b, coalesce(b30, 0) as b30, coalesce(buyers, 0) as buyers, coalesce(repeats, 0) as repeats, coalesce(ts, 0) as ts from prod cross join dy left join c on c.product_id = prod.id and c.day = dy.day left join u on u.product_id = prod.id and u.day = dy.day)
    select product_id, day, v as view_count_total, v30 as view_count_30d, v7 as view_count_7d, c30 as cart_count_30d, b as purchase_count_total, b30 as purchase_count_30d, buyers as distinct_buyers, round(repeats, 5) as repeat_purchase_rate,
        round(case when max(ts) over w > min(ts) over w then (ts - min(ts) over w) / (max(ts) over w - min(ts) over w) else 0 end, 5) as trending_score, round((b30 + 20 * case when sum(v30) over w > 0 then sum(b30) over w / sum(v30) over w else 0 end) / (v30 + 20), 5) as conversion_rate
    from q window w as (partition by day)""",
    "ev prod ia",
)

HISTORY_SQL = "ph as (select user_id, product_id, count(*) filter (event_type = 'PRODUCT_VIEW') as view_count, count(*) filter (event_type = 'ADD_TO_CART') as cart_count, count(*) filter (event_type = 'PURCHASE') as purchase_count, (any_value(now_us) - max(us)) / 86400e6 as days from pre, clock group by all)"
register("f26_pair_history", on(lambda t: rounded(features.pair_history(t.rows, t.now), "days_since_interaction", digits=4)), f"with {PRE_SQL}, {HISTORY_SQL} select user_id, product_id, view_count, cart_count, purchase_count, round(days, 4) as days_since_interaction from ph", "ev prod ia clock")


def pair_table(t: Tables, candidates=None, products=None, users=None):
    w = matrix(t)
    pairs = candidates if candidates is not None else t.rows.select("user_id", (F.col("product_id") + 1).alias("product_id")).distinct()
    products, users = product_table(t) if products is None else products, user_table(t) if users is None else users
    return features.pair_features(pairs, features.pair_history(t.rows, t.now), w, features.affinity(t.rows, w, t.products, "category_id", 10), features.affinity(t.rows, w, t.products, "brand_id", 6), products, users)


register(
    "f27_pair_features",
    on(lambda t: rounded(pair_table(t), "days_since_interaction", "interaction_weight", "category_affinity", "brand_affinity", "price_distance", digits=8).drop("content_similarity", "collaborative_score")),
    f"""with {PRE_SQL}, {MATRIX_SQL}, {HISTORY_SQL}, {PRODUCT_SQL}, {USER_SQL}, ca as (select * from (with {AFF_SQL.format(level="category_id", n=10)} select * from af)), ba as (select * from (with {AFF_SQL.format(level="brand_id", n=6)} select * from af)),
    cd as (select distinct user_id, product_id + 1 as product_id from ia),
    j as (select cd.user_id, cd.product_id, coalesce(view_count, 0) as view_count, coalesce(cart_count, 0) as cart_count, coalesce(purchase_count, 0) as purchase_count, coalesce(days, 999) as days, coalesce(mx.weight, 0) as w, coalesce(ca.affinity, 0) as ca, coalesce(ba.affinity, 0) as ba, abs(coalesce(q.price_percentile, 0.5) - coalesce(b.ppm, 0.5)) as far
        from cd left join ph using (user_id, product_id) left join mx using (user_id, product_id) left join q using (product_id) left join prod on cd.product_id = prod.id left join ca on ca.user_id = cd.user_id and ca.key_id = prod.category_id left join ba on ba.user_id = cd.user_id and ba.key_id = prod.brand_id left join (select user_id, coalesce(price_percentile_mean, 0) as ppm from b) b on b.user_id = cd.user_id)
    select user_id, product_id, view_count, cart_count, purchase_count, round(days, 8) as days_since_interaction, round(w, 8) as interaction_weight, (w > 0)::int as has_interacted, (purchase_count > 0)::int as has_purchased, round(ca, 8) as category_affinity, round(ba, 8) as brand_affinity, (ca > 0)::int as category_match, (ba > 0)::int as brand_match, round(far, 8) as price_distance, (far < 0.2)::int as price_band_match from j""",
    "ev prod ia clock ord",
)

# G. popularity
POP_SQL = "sp as (select product_id, ln(1 + sum(weight)) as s from mx group by 1)"
register("g3_popular", on(lambda t: rounded(popularity.popular(matrix(t), 50), "score")), f"with {MATRIX_SQL}, {POP_SQL}, n as (select product_id, (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from sp) select product_id, round(score, 6) as score, row_number() over (order by score desc, product_id)::int as rank from n qualify rank <= 50", "ev prod ia clock")
CAT_SQL = "pk as (select product_id, category_id, case when max(s) over w > min(s) over w then (s - min(s) over w) / (max(s) over w - min(s) over w) when max(s) over w = 0 then 0 else 1 end as score from sp join prod on sp.product_id = prod.id window w as (partition by category_id))"
register("g4_popular_by_category", on(lambda t: rounded(popularity.popular_by_category(matrix(t), t.products), "score").select("category_id", "product_id", "score")), f"with {MATRIX_SQL}, {POP_SQL}, {CAT_SQL} select category_id, product_id, round(score, 6) as score from pk", "ev prod ia clock")
TREND_FIT = f"ft as (select product_id, sum({TREND_SQL} * pow(0.5, (now_us - us) / 3600e6 / 42.0)) as s from ia, clock where us < now_us and (now_us - us) / 3600e6 <= 168 group by 1 having s > 0)"
register("g6_trending", on(lambda t: rounded(popularity.trending(t.rows, t.now, 50), "score")), f"with {TREND_FIT}, n as (select product_id, (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from ft) select product_id, round(score, 6) as score, row_number() over (order by score desc, product_id)::int as rank from n qualify rank <= 50", "ev prod ia clock")
register("g6_trending_by_category", on(lambda t: rounded(popularity.trending_by_category(t.rows, t.products, t.now, 10), "score").select("category_id", "product_id", "score", "rank")), f"with {TREND_FIT}, {CAT_SQL.replace('from sp join prod on sp.', 'from ft as sp join prod on sp.')} select category_id, product_id, round(score, 6) as score, row_number() over (partition by category_id order by score desc, product_id)::int as rank from pk qualify rank <= 10", "ev prod ia clock")
RECOMMEND_SQL = """al as (select product_id, (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from sp),
parts as (select user_id, product_id, affinity * pk.score as part from af join pk on af.key_id = pk.category_id union all select u.user_id, al.product_id, {share} * al.score from (select distinct user_id from ia) u, al),
rc as (select user_id, product_id, sum(part) as score from parts where not exists (select 1 from ia where ia.user_id = parts.user_id and ia.product_id = parts.product_id) group by all)"""


def popular_lists(t: Tables, k: int = 10):
    w = matrix(t)
    every = popularity.popular(w, 5000)
    return popularity.recommend(features.affinity(t.rows, w, t.products, "category_id", 10), popularity.popular_by_category(w, t.products), every, t.rows.select("user_id", "product_id").distinct(), t.rows.select("user_id").distinct(), k)


register("g5_popular_for_users", on(lambda t: rounded(popular_lists(t), "score").select("user_id", "product_id", "score", "rank")), f"with {MATRIX_SQL}, {POP_SQL}, {CAT_SQL}, {AFF_SQL.format(level='category_id', n=10)}, {RECOMMEND_SQL.format(share=0.15)} select user_id, product_id, round(score, 6) as score, row_number() over (partition by user_id order by score desc, product_id)::int as rank from rc qualify rank <= 10", "ev prod ia clock")
TREND_CAT_SQL = CAT_SQL.replace("from sp join prod on sp.", "from ft as sp join prod on sp.")


def trending_lists(t: Tables, k: int = 10):
    w = matrix(t)
    return popularity.recommend(features.affinity(t.rows, w, t.products, "category_id", 10), popularity.trending_by_category(t.rows, t.products, t.now), popularity.trending(t.rows, t.now), seen_pairs(t), t.rows.select("user_id").distinct(), k, share=0.25)


seen_pairs = lambda t: t.rows.select("user_id", "product_id").distinct()
register("g7_trending_for_users", on(lambda t: rounded(trending_lists(t), "score").select("user_id", "product_id", "score", "rank")), f"with {MATRIX_SQL}, {TREND_FIT}, {TREND_CAT_SQL}, {AFF_SQL.format(level='category_id', n=10)}, {RECOMMEND_SQL.format(share=0.25).replace('from sp)', 'from ft)')} select user_id, product_id, round(score, 6) as score, row_number() over (partition by user_id order by score desc, product_id)::int as rank from rc qualify rank <= 10", "ev prod ia clock")
register("g27_top_by_brand", on(lambda t: rounded(popularity.top_by_group(popularity.popular_scores(matrix(t)), t.products, "brand_id", 40), "score").select("brand_id", "product_id", "score", "rank")), f"with {MATRIX_SQL}, {POP_SQL}, al as (select product_id, (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from sp) select brand_id, prod.id as product_id, round(coalesce(score, 0), 6) as score, row_number() over (partition by brand_id order by coalesce(score, 0) desc, prod.id)::int as rank from prod left join al on al.product_id = prod.id qualify rank <= 40", "ev prod ia clock")
assert TREND_WEIGHTS["PURCHASE"] == 12.0
