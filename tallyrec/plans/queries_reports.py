"""Queries of quality gates, experiments, serving-log analytics, drift and the promotion gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrec.functions.columns import stable_bucket
from tallyrec.operators import analytics, asof, drift, profiles, quality, significance, weighting
from tallyrec.plans.queries_base import last_days, trained
from tallyrec.plans.queries_lists import accuracy
from tallyrec.plans.registry import Tables, on, register, rounded
from tallyrec.session import checkpointed

IA = "ev prod ia"

# C. quality
register("c1_training_contract", on(lambda t: quality.training_contract(t.rows, t.products).select("check", "measured", "passed")), "select 'enough_interactions' as \"check\", count(*)::double as measured, count(*) >= 1000 as passed from ia union all select 'no_null_ids', count(*) filter (user_id is null or product_id is null)::double, count(*) filter (user_id is null or product_id is null) = 0 from ia union all select 'no_orphan_products', count(*)::double, count(*) = 0 from ia where product_id not in (select id from prod)", IA)
register("c2_orphan_users", on(lambda t: quality.orphans(t.orders, t.users, "user_id", "id")), "select count(*) as n from ord where user_id not in (select id from usr)", "ord usr")
register("c3_row_counts", on(lambda t: quality.row_counts({"events": t.events, "products": t.products}, {"events": 100, "products": 10_000_000}).select("check", "measured", "passed")), "select 'rows_events' as \"check\", count(*)::double as measured, count(*) >= 100 as passed from events union all select 'rows_products', count(*)::double, count(*) >= 10000000 from part")
register("c4_rows_by_month", on(lambda t: quality.rows_by_month(t.events)), "select strftime(occurred_at, '%Y-%m') as month, count(*) as n from ev group by 1", "ev")
register("c5_event_mix", on(lambda t: quality.event_mix(t.events)), "select event_type, count(*) as n, round(count(*) / (select count(*) from ev), 6) as share from ev group by 1", "ev")
register("c6_top_percent_share", on(lambda t: quality.top_percent_share(t.events)), "with c as (select product_id, count(*) as n from ev where event_type = 'PRODUCT_VIEW' and product_id is not null group by 1), k as (select n, ntile(100) over (order by n desc, product_id) as tile from c) select round(sum(n) filter (tile = 1) / sum(n), 6) as share from k", "ev")
TOP_SQL = "with c as (select user_id, {0}, count(*) as n from ia where event_type = 'PRODUCT_VIEW' and {0} is not null group by all), u as (select max(n) / sum(n) as s, sum(n) as total from c group by user_id having sum(n) >= 5) select round(quantile_cont(s, 0.5), 6) as median_share, count(*) as users from u"
register("c7_category_share", on(lambda t: quality.top_share_median(t.rows, "category_id")), TOP_SQL.format("category_id"), IA)
register("c12_brand_share", on(lambda t: quality.top_share_median(t.rows, "brand_id")), TOP_SQL.format("brand_id"), IA)
register("c8_span", on(lambda t: quality.span_days(t.events)), "select datediff('day', min(occurred_at), max(occurred_at))::int as days from ev", "ev")
register("c9_recent_of_user", on(lambda t: quality.recent_of_user(t.events, 7)), "select event_id, event_type, product_id from ev where user_id = 7 order by occurred_at desc, event_id desc limit 50", "ev")
register("c10_available", on(lambda t: quality.available(t.products, "ECONOMY")), "select id, price from prod where category_id = 'ECONOMY' and is_active and stock_quantity > 0 order by price, id limit 50", "prod")
register("c11_bought_with", on(lambda t: quality.bought_with(t.items, 11)), "select product_id, count(distinct order_id) as n from items where product_id <> 11 and order_id in (select order_id from items where product_id = 11) group by 1 order by n desc, product_id limit 10", "items")
PREFER_SQL = "pf as (select user_id, arg_min(category_id, struct_pack(a := -n, b := category_id)) as preferred from (select user_id, category_id, count(*) as n from ia where category_id is not null group by all) group by 1)"


def preferred(t: Tables):
    counts = t.rows.filter("category_id is not null").groupBy("user_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("category_id", F.struct(-F.col("n"), F.col("category_id"))).alias("preferred"))


register("c13_affinity_lift", on(lambda t: quality.affinity_lift(t.rows, preferred(t))), f"with {PREFER_SQL}, m as (select event_type, category_id = preferred as inside from ia join pf using (user_id)), r as (select count(*) filter (event_type = 'PURCHASE' and inside) / count(*) filter (event_type = 'PRODUCT_VIEW' and inside) as a, count(*) filter (event_type = 'PURCHASE' and not inside) / count(*) filter (event_type = 'PRODUCT_VIEW' and not inside) as b from m) select round(a, 6) as inside, round(b, 6) as outside, round(a / b, 6) as lift from r", IA)
register(
    "c14_brand_over_index",
    on(lambda t: quality.brand_over_index(t.rows, t.rows.filter("event_type = 'PRODUCT_VIEW' and brand_id is not null").groupBy("user_id").agg(F.collect_set("brand_id").alias("brands")), t.products)),
    "with l as (select user_id, list(distinct brand_id) as brands from ia where event_type = 'PRODUCT_VIEW' and brand_id is not null group by 1), s as (select avg(list_contains(brands, brand_id)::int) as share, count(*) as n from ia join l using (user_id) where event_type = 'PURCHASE'), e as (select avg(e) as expected from (select user_id, count(*) / (select count(*) from prod) as e from (select user_id, unnest(brands) as brand_id from l) join prod using (brand_id) group by 1)) select round(share, 6) as share, round(expected, 6) as expected, round(share / expected, 6) as index, n from s, e",
    IA,
)
register("c15_correlation", on(lambda t: quality.correlation(t.rows.groupBy("user_id").agg(F.avg("price").alias("x"), F.count(F.lit(1)).cast("double").alias("y")), "x", "y")), "with p as (select avg(price) as x, count(*)::double as y from ia group by user_id), f as (select corr(x, y) as r, count(*) as n from p) select round(r, 6) as r, round(tanh(atanh(r) - 1.959963985 / sqrt(n - 3.0)), 6) as low, n from f", IA)
register(
    "c16_pair_lift",
    on(lambda t: quality.pair_lift(t.items.join(t.products.select(F.col("id").alias("product_id"), F.col("brand_id").alias("group")), "product_id"), t.spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#21", "Brand#33"), ("none", "Brand#12")], "a string, b string"))),
    "with s as (select distinct order_id, brand_id as g from items join prod on items.product_id = prod.id), c as (select g, count(*) as n from s group by 1), d(a, b) as (values ('Brand#11', 'Brand#12'), ('Brand#21', 'Brand#33'), ('none', 'Brand#12')), x as (select d.a, d.b, count(*) as n from d join s p on p.g = d.a join s q on q.g = d.b and q.order_id = p.order_id group by all) select d.a, d.b, coalesce(x.n, 0) as n_ab, case when ca.n >= 20 and cb.n >= 20 then round(coalesce(x.n, 0) * (select count(distinct order_id) from s)::double / (ca.n * cb.n), 6) end as lift from d left join x using (a, b) left join c ca on ca.g = d.a left join c cb on cb.g = d.b",
    "prod items",
)
register("c17_relatedness", on(lambda t: quality.consecutive_relatedness(t.rows)), "with v as (select *, lag(category_id) over (partition by session_key order by us, product_id) as before from ia where event_type = 'PRODUCT_VIEW'), s as (select avg((before = category_id)::int) as same, count(*) as n from v where before is not null), c as (select sum(m * m) / pow(sum(m), 2) as chance from (select count(*)::double as m from v group by category_id)) select round(same, 6) as same, round(chance, 6) as chance, round(same / chance, 6) as lift, n from s, c", IA)
register("c18_segment_spend", on(lambda t: rounded(quality.segment_spend(t.orders, t.users), "mean_spend", digits=2)), "select segment, count(*) as users, round(round(avg(coalesce(s, 0)), 4), 2) as mean_spend from usr left join (select user_id, sum(grand_total) as s from ord group by 1) o on o.user_id = usr.id group by 1", "ord usr")
register("c19_gini", on(lambda t: quality.popularity_skew(t.rows, t.products)), "with c as (select id, count(v.product_id) as n from prod left join (select product_id from ia where event_type = 'PRODUCT_VIEW') v on v.product_id = id group by 1), r as (select n, row_number() over (order by n) as i, count(*) over () as m from c) select round(2 * sum(i * n) / (any_value(m) * sum(n)) - (any_value(m) + 1) / any_value(m), 6) as gini from r", IA)
register("c20_density", on(lambda t: quality.density(t.rows)), "with p as (select distinct user_id, product_id from ia), f as (select count(*) as pairs, count(distinct user_id) as u, count(distinct product_id) as p from p) select pairs, round(pairs / (u * p), 6) as density, round(greatest(0.01, 20.0 / p), 6)::double as threshold from f", IA)
register("c21_repeat_share", on(lambda t: quality.repeat_share(t.rows)), "select round(avg((n > 1)::int), 6) as repeat_share, count(*) as pairs from (select count(*) as n from ia where event_type = 'PURCHASE' group by user_id, product_id)", IA)
register("c22_cold_start", on(lambda t: quality.cold_start(t.rows, t.users, t.products)), "with u as (select usr.id, count(ia.user_id) as n from usr left join ia on ia.user_id = usr.id group by 1) select count(*) filter (n = 0) as cold_users, count(*) filter (n <= 3) as sparse_users, (select count(*) from prod where id not in (select product_id from ia)) as untouched_products from u", "ev prod ia usr")
register("c23_temporal_coverage", on(lambda t: quality.temporal_coverage(t.events)), "with d as (select occurred_at::date as day, count(*) as n from ev group by 1), s as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from d), f as (select coalesce(n, 0) as n from s left join d using (day)) select round(avg((n > 0)::int), 6) as active_share, round(stddev_samp(n) / avg(n), 6) as variation, count(*) as days from f", "ev")
register("c24_funnel", on(lambda t: quality.funnel_ratios(t.rows)), "select round(count(*) filter (event_type = 'PURCHASE') / count(*) filter (event_type = 'PRODUCT_VIEW'), 6) as view_to_purchase, round(count(*) filter (event_type = 'ADD_TO_CART') / count(*) filter (event_type = 'PRODUCT_VIEW'), 6) as view_to_cart, (select round(avg(b), 6) from (select max((event_type = 'PURCHASE')::int) as b from ia group by session_key)) as session_conversion from ia", IA)
register("c24_items_per_order", on(lambda t: quality.items_per_order(t.items)), "select round(avg(n), 6) as items_per_order, count(*) as orders from (select count(*) as n from items group by order_id)", "items")
register("c25_unreconciled", on(lambda t: quality.unreconciled(t.orders.withColumnRenamed("grand_total", "subtotal"), t.items).select("id")), "select ord.id from ord join (select order_id, sum(line_total) as s from items group by 1) i on i.order_id = ord.id where abs(s - grand_total) > 0.02", "ord items")
register("c26_early_views", on(lambda t: quality.early_views(t.rows, t.products)), "select count(*) filter (occurred_at::date < released_at) as early, count(*) as views from ia join prod on prod.id = ia.product_id where event_type = 'PRODUCT_VIEW'", IA)
register("c26_session_mismatches", on(lambda t: _mismatches(t)), "select session_key from ev group by 1 having bool_or(event_id % 50 = 0)", "ev")
register("c27_gate", on(lambda t: quality.gate([quality.training_contract(t.rows, t.products), quality.row_counts({"events": t.events}, {"events": 10**12})])), "select (3 + 0)::bigint as passed, 1::bigint as failed, 0::bigint as inconclusive, false as all_passed")


def _mismatches(t: Tables):
    from tallyrec.operators.counters import roll_up_sessions

    sessions = roll_up_sessions(t.events)
    fewer = t.events.filter("event_id % 50 <> 0")
    return quality.session_mismatches(fewer, sessions).select("session_key")


# L. experiments
BUCKET_SQL = "('0x' || substr(sha256({0}), 1, 16))::ubigint % 10000"
register("l5_stable_buckets", on(lambda t: t.users.select("id", stable_bucket(F.col("id").cast("string")).alias("bucket"))), f"select id, ({BUCKET_SQL.format('id::varchar')})::int as bucket from usr", "usr")


def experiments(t: Tables):
    return t.spark.createDataFrame(
        [("exp1", "running", 0.05, [("control", 0.5), ("treatment", 0.5)]), ("exp2", "running", 0.0, [("a", 0.2), ("b", 0.3), ("c", 0.5)]), ("old", "stopped", 0.0, [("a", 1.0)]), ("bad", "running", 0.0, [("a", 0.7)])],
        "key string, status string, holdout double, variants array<struct<name:string,allocation:double>>",
    )


ASSIGN_SQL = f"""asg as (select id::varchar as subject, 'exp1' as key, case when ({BUCKET_SQL.format("'exp1:holdout:' || id")}) / 10000 < 0.05 then 'holdout' when ({BUCKET_SQL.format("'exp1:' || id")}) / 10000 < 0.5 then 'control' else 'treatment' end as variant from usr
union all select id::varchar, 'exp2', case when ({BUCKET_SQL.format("'exp2:' || id")}) / 10000 < 0.2 then 'a' when ({BUCKET_SQL.format("'exp2:' || id")}) / 10000 < 0.5 then 'b' else 'c' end from usr)"""
assigned = lambda t: significance.assign(t.users.withColumnRenamed("id", "subject"), experiments(t))
register("l7_assignments", on(assigned), f"with {ASSIGN_SQL} select * from asg", "usr")
register("l6_variant_ranges", on(lambda t: significance.variant_ranges(experiments(t)).join(assigned(t).groupBy("key", "variant").agg(F.count(F.lit(1)).alias("n")), ["key", "variant"]).select("key", "variant", "low", "high", "n")), f"with {ASSIGN_SQL}, r(key, variant, low, high) as (values ('exp1', 'control', 0.0::double, 0.5::double), ('exp1', 'treatment', 0.5, 1.0), ('exp2', 'a', 0.0, 0.2), ('exp2', 'b', 0.2, 0.5), ('exp2', 'c', 0.5, 1.0)) select r.key, r.variant, low, high, count(*) as n from r join asg on asg.key = r.key and asg.variant = r.variant group by all", "usr")


def merged(t: Tables):
    configs = t.spark.createDataFrame([("exp1", "treatment", {"k": "12", "theme": "new"}), ("exp2", "a", {"k": "20"}), ("exp2", "b", {"depth": "3"})], "key string, variant string, config map<string,string>")
    return significance.merge_configs(assigned(t), configs).select("subject", F.col("config")["k"].alias("k"), F.col("config")["theme"].alias("theme"), F.col("config")["depth"].alias("depth"))


register("l8_merged_configs", on(merged), f"with {ASSIGN_SQL}, m as (select subject, max(variant) filter (key = 'exp1') as v1, max(variant) filter (key = 'exp2') as v2 from asg group by 1) select subject, case when v2 = 'a' then '20' when v1 = 'treatment' then '12' end as k, case when v1 = 'treatment' then 'new' end as theme, case when v2 = 'b' then '3' end as depth from m where v1 = 'treatment' or v2 in ('a', 'b')", "usr")


def definitions(t: Tables):
    raw = t.users.select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, '[{"name":"a","allocation":0.4},{"name":"b","allocation":0.6}]').when(F.col("id") % 3 == 1, "not json").otherwise('[{"name":"a","allocation":0.9}]').alias("definition"))
    good, bad = significance.parse_experiments(raw)
    return good.select("key", F.lit("good").alias("verdict")).unionByName(bad.select("key", F.lit("malformed").alias("verdict")))


register("l9_definitions", on(definitions), "select id::varchar as key, case when id % 3 = 0 then 'good' else 'malformed' end as verdict from usr", "usr")
register("l10_exposures", on(lambda t: significance.exposures(t.events.select(F.lit("exp").alias("key"), F.col("user_id").alias("subject"), "occurred_at", F.col("event_type").alias("variant")))), "select 'exp' as key, user_id as subject, min(us) as first_us, arg_min(event_type, us) as variant from ev group by user_id", "ev")
ARMS_SQL = "ar as (select user_id, case when ('0x' || substr(sha256(user_id::varchar), 1, 16))::ubigint % 10000 < 5000 then 'control' else 'treatment' end as variant, event_type from ia)"
arm = lambda t: t.rows.withColumn("variant", F.when(stable_bucket(F.col("user_id").cast("string")) < 5000, "control").otherwise("treatment"))


#: Both tails of the standard normal beyond z, by the same approximation as ``functions.columns.normal_cdf``.
TAIL_SQL = "round(2 * exp(-{0} * {0} / 2) / 2.5066282746310002 * (1 / (1 + 0.2316419 * {0})) * (0.319381530 + (1 / (1 + 0.2316419 * {0})) * (-0.356563782 + (1 / (1 + 0.2316419 * {0})) * (1.781477937 + (1 / (1 + 0.2316419 * {0})) * (-1.821255978 + (1 / (1 + 0.2316419 * {0})) * 1.330274429)))), 6)"


def proportions(t: Tables):
    n = lambda v, clicks=False: F.sum(((F.col("variant") == v) & ((F.col("event_type") == "PRODUCT_CLICK") if clicks else F.lit(True))).cast("int"))
    counts = arm(t).agg(n("control", True).alias("x1"), n("control").alias("n1"), n("treatment", True).alias("x2"), n("treatment").alias("n2"))
    return rounded(significance.two_proportions(counts), "rate_1", "rate_2", "difference", "z", "low", "high", "p_value")


register(
    "l2_two_proportions",
    on(proportions),
    f"""with {ARMS_SQL}, c as (select count(*) filter (variant = 'control' and event_type = 'PRODUCT_CLICK') as x1, count(*) filter (variant = 'control') as n1, count(*) filter (variant = 'treatment' and event_type = 'PRODUCT_CLICK') as x2, count(*) filter (variant = 'treatment') as n2 from ar),
    p as (select *, x1 / n1 as p1, x2 / n2 as p2, (x1 + x2) / (n1 + n2) as p from c), z as (select *, (p2 - p1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) as z, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as se from p)
    select x1, n1, x2, n2, round(p1, 6) as rate_1, round(p2, 6) as rate_2, round(p2 - p1, 6) as difference, round(z, 6) as z, round(p2 - p1 - 1.959963985 * se, 6) as low, round(p2 - p1 + 1.959963985 * se, 6) as high, {TAIL_SQL.format('abs(z)')} as p_value, abs(z) > 1.959963985 as significant from z""",
    IA,
)
register("l3_sample_ratio", on(lambda t: rounded(analytics.readout_mismatch(arm(t), {"control": 0.5, "treatment": 0.5}), "chi_square", "p_value").select("chi_square", "p_value", "mismatch")), f"with {ARMS_SQL}, n as (select count(distinct user_id) filter (variant = 'control')::double as a, count(distinct user_id) filter (variant = 'treatment')::double as b from ar) select round(2 * pow(a - (a + b) / 2, 2) / ((a + b) / 2), 6) as chi_square, {TAIL_SQL.format('sqrt(2 * pow(a - (a + b) / 2, 2) / ((a + b) / 2))')} as p_value, sqrt(2 * pow(a - (a + b) / 2, 2) / ((a + b) / 2)) > 3.290527 as mismatch from n", IA)
register("l1_paired_bootstrap", on(lambda t: significance.paired_bootstrap(accuracy(t), "popular", "recent")))
revenue = lambda t: arm(t).groupBy("user_id", "variant").agg(F.sum(F.when(F.col("event_type") == "PURCHASE", F.col("price")).otherwise(0.0)).alias("revenue"))
register("l4_mean_bootstrap", on(lambda t: significance.mean_bootstrap(revenue(t), "variant", "revenue")))
register("l4_mean_interval", on(lambda t: rounded(significance.mean_interval(arm(t).groupBy("user_id", "variant").agg(F.sum(F.when(F.col("event_type") == "PURCHASE", F.col("price")).otherwise(0.0)).alias("revenue")), "variant", "revenue"), "mean", "low", "high", digits=4)), f"with {ARMS_SQL.replace('event_type from', 'event_type, price from')}, u as (select user_id, variant, sum(case when event_type = 'PURCHASE' then coalesce(price, 0) else 0 end) as r from ar group by all) select variant, count(*) as users, round(avg(r), 4) as mean, round(avg(r) - 1.959963985 * stddev_samp(r) / sqrt(count(*)), 4) as low, round(avg(r) + 1.959963985 * stddev_samp(r) / sqrt(count(*)), 4) as high from u group by 1", IA)

# M. the serving log: views are impressions; clicks and purchases by the same user of the same product answer them
LOG_SQL = """im as (select event_id as recommendation_id, user_id, product_id, us, case event_id % 3 when 0 then 'home' when 1 then 'product' else 'cart' end as surface, case event_id % 4 when 0 then 'popular' when 1 then 'ranker' else 'hybrid' end as strategy, event_id % 10 as position,
    case when ('0x' || substr(sha256(user_id::varchar), 1, 16))::ubigint % 10000 < 5000 then 'control' else 'treatment' end as variant from ia where event_type = 'PRODUCT_VIEW'),
ck as (select im.recommendation_id, ia.us from im join ia using (user_id, product_id) where ia.event_type = 'PRODUCT_CLICK'), cv as (select im.recommendation_id, ia.price as revenue from im join ia using (user_id, product_id) where ia.event_type = 'PURCHASE'),
ou as (select im.*, coalesce(c.n, 0) as n_clicks, coalesce(v.n, 0) as n_conversions, coalesce(v.r, 0) as revenue from im left join (select recommendation_id, count(*) as n from ck group by 1) c using (recommendation_id) left join (select recommendation_id, count(*) as n, sum(revenue) as r from cv group by 1) v using (recommendation_id))"""
COUNTS_SQL = "count(*) as impressions, sum(n_clicks)::bigint as clicks, sum(n_conversions)::bigint as conversions, round(sum(revenue), 6) as revenue, count(distinct user_id) as users, round(coalesce(sum(n_clicks) / count(*), 0), 6) as ctr, round(coalesce(sum(n_conversions) / nullif(sum(n_clicks), 0), 0), 6) as cvr, round(coalesce(round(sum(revenue), 6) / count(distinct user_id), 0), 6) as revenue_per_user, round(coalesce(round(sum(revenue), 6) / nullif(sum(n_conversions), 0), 0), 6) as aov"


def log(t: Tables):
    n = F.col("event_id")
    shown = t.events.filter("event_type = 'PRODUCT_VIEW' and product_id is not null").select(n.alias("recommendation_id"), "user_id", "product_id", "occurred_at", F.when(n % 3 == 0, "home").when(n % 3 == 1, "product").otherwise("cart").alias("surface"), F.when(n % 4 == 0, "popular").when(n % 4 == 1, "ranker").otherwise("hybrid").alias("strategy"), (n % 10).alias("position"), F.when(stable_bucket(F.col("user_id").cast("string")) < 5000, "control").otherwise("treatment").alias("variant"))
    keys = shown.select("recommendation_id", "user_id", "product_id")
    answers = lambda kind: keys.join(t.rows.filter(F.col("event_type") == kind).select("user_id", "product_id", "occurred_at", "price"), ["user_id", "product_id"])
    clicks = answers("PRODUCT_CLICK").select("recommendation_id", "occurred_at")
    conversions = answers("PURCHASE").select("recommendation_id", F.col("price").alias("revenue"))
    return shown, clicks, conversions


outcomes = lambda t: analytics.outcomes(*log(t))
register("m1_funnel_by_surface", on(lambda t: analytics.funnel(outcomes(t), "surface")), f"with {LOG_SQL} select surface, {COUNTS_SQL} from ou group by 1", IA)
register("m3_overview", on(lambda t: analytics.overview(outcomes(t), ["surface", "strategy", "variant"])), f"with {LOG_SQL} select 'total' as slice, 'all' as value, {COUNTS_SQL} from ou union all select 'surface', surface, {COUNTS_SQL} from ou group by surface union all select 'strategy', strategy, {COUNTS_SQL} from ou group by strategy union all select 'variant', variant, {COUNTS_SQL} from ou group by variant", IA)
register("m4_fallback_rate", on(lambda t: rounded(analytics.fallback_rate(log(t)[0]), "fallback_rate")), f"with {LOG_SQL} select count(*) as served, round(avg((strategy not in ('ranker', 'hybrid'))::int), 6) as fallback_rate from im", IA)
register("m5_top_products", on(lambda t: analytics.top_products(outcomes(t))), f"with {LOG_SQL} select product_id, count(*) as served, sum(n_clicks)::bigint as clicks, sum(n_conversions)::bigint as conversions, round(sum(revenue), 6) as revenue, round(sum(n_clicks) / count(*), 6) as ctr from ou group by 1 order by served desc, product_id limit 20", IA)
register("m6_readout", on(lambda t: rounded(analytics.experiment_readout(outcomes(t), least_users=10).filter("metric = 'ctr'"), "rate_1", "rate_2", "difference").select("variant", "metric", "rate_1", "rate_2", "difference", "ready")), f"with {LOG_SQL}, a as (select variant, sum(n_clicks) / count(*) as r, count(distinct user_id) as u from ou group by 1) select t.variant, 'ctr' as metric, round(c.r, 6) as rate_1, round(t.r, 6) as rate_2, round(t.r - c.r, 6) as difference, least(t.u, c.u) >= 10 as ready from a t, a c where t.variant = 'treatment' and c.variant = 'control'", IA)
register(
    "m7_attribution",
    on(lambda t: analytics.attribute(t.events.filter("event_type = 'PURCHASE' and product_id is not null"), t.events.filter("event_type = 'PRODUCT_CLICK' and product_id is not null"))),
    "with p as (select * from ia where event_type = 'PURCHASE'), c as (select * from ia where event_type = 'PRODUCT_CLICK'), m as (select p.event_id as purchase_id, p.user_id, p.product_id, arg_max(c.event_id, struct_pack(a := c.us, b := c.event_id)) as click_id from p left join c on c.user_id = p.user_id and c.product_id = p.product_id and c.us <= p.us and c.us >= p.us - 168 * 3600000000 group by all) select purchase_id, user_id, product_id, click_id, 'last_click' as policy, 168 as window_hours from m",
    IA,
)
register("m8_impression_clicks", on(lambda t: analytics.impression_clicks(*log(t)[:2]).select("recommendation_id", F.coalesce("n_clicks", F.lit(0)).alias("n_clicks"), "delay_ms")), f"with {LOG_SQL} select recommendation_id, count(ck.us) as n_clicks, (min(ck.us) - any_value(im.us)) / 1000 as delay_ms from im left join ck using (recommendation_id) group by 1", IA)
register("m9_position_curve", on(lambda t: analytics.position_curve(outcomes(t))), f"with {LOG_SQL} select position, count(*) as impressions, count(*) filter (n_clicks > 0) as clicked, round(count(*) filter (n_clicks > 0) / count(*), 6) as ctr from ou group by 1", IA)
register(
    "m10_health",
    on(lambda t: rounded(analytics.health(log(t)[0].select(F.col("occurred_at").alias("at"), "surface", "strategy", (F.col("recommendation_id") % 100).cast("double").alias("latency_ms"), (F.col("recommendation_id") % 20).alias("n_items"), (F.col("recommendation_id") % 5 > 0).alias("cached"))), "measured")),
    f"with {LOG_SQL}, f as (select us // 300000000 * 300000000 as window_us, surface, avg((strategy not in ('ranker', 'hybrid'))::int) as fb, quantile_cont((recommendation_id % 100)::double, 0.95) as p95, avg((recommendation_id % 20 = 0)::int) as em, avg((recommendation_id % 5 > 0)::int) as ca from im group by all) select window_us, surface, 'fallback_rate' as rule, round(fb, 6) as measured, 0.25::double as threshold from f where fb > 0.25 union all select window_us, surface, 'slow', round(p95, 6), 80 from f where p95 > 80 union all select window_us, surface, 'empty', round(em, 6), 0.05 from f where em > 0.05 union all select window_us, surface, 'cold_cache', round(ca, 6), 0.6 from f where ca < 0.6",
    IA,
)

# N. drift: the first half of the month against the second
HALVES_SQL = "hv as (select 'value' as feature, value, day(occurred_at) <= 15 as early from ev union all select 'product', product_id::double, day(occurred_at) <= 15 from ev)"


def halves(t: Tables):
    rows = t.events.withColumn("product", F.col("product_id").cast("double"))
    early = F.dayofmonth("occurred_at") <= 15
    return rows.filter(early), rows.filter(~early)


def stacks(t: Tables):
    return [drift.stacked(h, ["value", "product"]) for h in halves(t)]


PSI_SQL = f"""{HALVES_SQL}, qs as (select feature, list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e from hv where early group by 1), eg as (select feature, list_sort(e)[2:len(e) - 1] as inner_, len(e) - 1 as bins from qs),
bn as (select h.feature, early, len(list_filter(inner_, lambda x : x <= value)) as bin from hv h join eg using (feature)), n as (select feature, bin, count(*) filter (early) as r, count(*) filter (not early) as c from bn group by all),
sh as (select feature, greatest(r / sum(r) over (partition by feature), 1e-6) as p, greatest(c / sum(c) over (partition by feature), 1e-6) as q from n), ps as (select feature, sum((q - p) * ln(q / p)) as psi from sh group by 1)"""
SEVERITY_SQL = "case when psi >= 0.25 then 'alert' when psi >= 0.1 then 'warning' else 'ok' end as severity"
register("n1_psi", on(lambda t: rounded(drift.psi_numeric(*stacks(t)), "psi")), f"with {PSI_SQL} select feature, round(psi, 6) as psi, {SEVERITY_SQL} from ps", "ev")
register("n2_psi_categories", on(lambda t: rounded(drift.psi_categorical(*[h.select(F.lit("event_type").alias("feature"), F.col("event_type").alias("value")) for h in halves(t)]), "psi")), f"with n as (select event_type, count(*) filter (day(occurred_at) <= 15) as r, count(*) filter (day(occurred_at) > 15) as c from ev group by 1), s as (select greatest(r / sum(r) over (), 1e-6) as p, greatest(c / sum(c) over (), 1e-6) as q from n), x as (select sum((q - p) * ln(q / p)) as psi from s) select 'event_type' as feature, round(psi, 6) as psi, {SEVERITY_SQL} from x", "ev")
KS_SQL = "kv as (select feature, value, count(*) filter (early) as r, count(*) filter (not early) as c from hv where value is not null group by all), kc as (select feature, abs(sum(r) over w / sum(r) over (partition by feature) - sum(c) over w / sum(c) over (partition by feature)) as gap from kv window w as (partition by feature order by value)), kk as (select feature, max(gap) as ks from kc group by 1)"
register("n3_ks", on(lambda t: rounded(drift.ks(*stacks(t)), "ks").select("feature", "ks")), f"with {HALVES_SQL}, {KS_SQL} select feature, round(ks, 6) as ks from kk", "ev")
register("n5_compare", on(lambda t: rounded(drift.compare(*halves(t), ["value", "product"]), "psi", "ks", "reference_mean", "current_mean").drop("ks_p_value")), f"with {PSI_SQL}, {KS_SQL}, fa as (select feature, round(avg(value) filter (early), 6) as reference_mean, count(value) filter (early) as reference_n, round(avg(value) filter (not early), 6) as current_mean, count(value) filter (not early) as current_n from hv group by 1) select feature, round(psi, 6) as psi, {SEVERITY_SQL}, round(ks, 6) as ks, reference_mean, reference_n, current_mean, current_n from ps join kk using (feature) join fa using (feature)", "ev")
register("n6_should_retrain", on(lambda t: drift.should_retrain(drift.compare(*halves(t), ["value", "product"]))), f"with {PSI_SQL} select count(*) filter (psi >= 0.25)::bigint as alerts, count(*) filter (psi >= 0.1 and psi < 0.25)::bigint as warnings, count(*) filter (psi >= 0.25) >= 2 or (count(*) filter (psi >= 0.25) >= 1 and count(*) filter (psi >= 0.1 and psi < 0.25) >= 3) as retrain from ps", "ev")


def watched(t: Tables):
    """Daily profiles of the 13 watched features: users as of the days they bought on, the catalogue as of the last ten days."""
    t.keep()
    users = asof.user_features_at(asof.user_days(t.rows, t.products), trained(t), t.orders)
    return profiles.watched_profiles(users, asof.product_features_at(asof.product_days(t.rows), t.products, last_days(t)))


def profile_drift(t: Tables):
    kept = checkpointed(watched(t))
    day = last_days(t)[-5]
    return profiles.compare_profiles(profiles.window_profile(kept, 0, day), profiles.window_profile(kept, day + 1, day + 10))


register("n5_profiles", on(profile_drift))
AUDIENCE = ["event_type", "device_type"]


def audiences(t: Tables):
    """Users of two weeks by event type, from one table of daily users by event type and device."""
    kept = profiles.daily_users(t.events, AUDIENCE)
    day = last_days(t)[-1]
    return profiles.exact_overlap(kept, (day - 13, day - 7), (day - 6, day), ["event_type"])


register(
    "m3_audience_overlap",
    on(audiences),
    "with d as (select event_type, user_id, us // 86400000000 as day, (select max(us) // 86400000000 from ia) as last from ev where user_id is not null), g as (select event_type, user_id, bool_or(day between last - 13 and last - 7) as a, bool_or(day between last - 6 and last) as b from d group by all) select event_type, count(*) filter (a) as a_users, count(*) filter (b) as b_users, count(*) filter (a and b) as both, count(*) filter (a or b) as either from g where a or b group by 1",
    "ev prod ia",
)

def metrics(t: Tables):
    counts = weighting.event_type_counts(t.rows)
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("event_type", (F.col("n") / F.col("total")).alias("value"))
    named = F.when(F.col("event_type") == "PURCHASE", "ndcg").when(F.col("event_type") == "ADD_TO_CART", "recall").when(F.col("event_type") == "PRODUCT_VIEW", "coverage").otherwise("diversity")
    candidate = shares.filter("event_type in ('PURCHASE', 'ADD_TO_CART', 'PRODUCT_VIEW')").select(named.alias("metric"), "value")
    return candidate, candidate.withColumn("value", F.col("value") - 0.01)


register("n7_gate", on(lambda t: rounded(drift.gate(*metrics(t)), "delta").select("metric", "delta", "passed", "outcome")), "with c as (select count(*) filter (event_type = 'PURCHASE') / count(*) as a from ia) select unnest(['ndcg', 'recall', 'coverage', 'diversity', 'novelty']) as metric, unnest([0.01, 0.01, 0.01, null, null]::double[]) as delta, unnest([true, true, true, false, false]) as passed, case when a >= 0.01 then 'promote' else 'reject' end as outcome from c", IA)
register("n8_incumbent", on(lambda t: drift.incumbent_of(t.products.select("name", "id", (F.col("id") % 1000 == 500).alias("is_primary"), (F.col("price") * F.col("id")).alias("ndcg")).withColumn("name", F.concat("name", F.lit("-"), F.col("id").cast("string")))).select("name")), "select name || '-' || id as name from prod order by (id % 1000 = 500) desc, price * id desc, 1 limit 1", "prod")
register("n10_one_production", on(lambda t: drift.one_production(t.products.select(F.col("brand_id").alias("name"), F.when(F.col("id") % 100 == 0, "production").otherwise("archived").alias("stage")))), "select brand_id as name, count(*) filter (id % 100 = 0)::bigint as n_production from prod group by 1 having count(*) filter (id % 100 = 0) > 1", "prod")
