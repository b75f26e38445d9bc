"""Event validation: rules as data, verdicts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrec.config import EVENT_TYPES, REFRESH_TYPES, SCOPED_TYPES, UNSCOPED_TYPES

#: key -> (kind, least, most); for texts the bounds are of the length.  Fixed values.
_CART = {"quantity": ("int", 1, 999), "variant_id": ("int", None, None)}
_SESSION = {"entry": ("text", 0, 60), "referrer": ("text", 0, 300)}
PAYLOAD_RULES = {
    "PRODUCT_VIEW": {"dwell_ms": ("int", 0, 3_600_000), "position": ("int", 0, 1000)},
    "PRODUCT_CLICK": {"position": ("int", 0, 1000)},
    "SEARCH": {"query": ("text", 1, 200), "results": ("int", 0, None), "filters": ("any", None, None)},
    "ADD_TO_CART": _CART,
    "REMOVE_FROM_CART": _CART,
    "WISHLIST": {},
    "PURCHASE": _CART,
    "PRODUCT_SHARE": {"channel": ("text", 0, 40)},
    "PRODUCT_RATING": {"rating": ("number", 1, 5)},
    "PRODUCT_REVIEW": {"rating": ("number", 1, 5), "length": ("int", 0, 20_000)},
    "SESSION_START": _SESSION,
    "SESSION_END": _SESSION,
}
REQUIRED = {"SEARCH": ("query",), "PRODUCT_RATING": ("rating",), "PRODUCT_REVIEW": ("rating",)}
DEFAULTS = {
    "PRODUCT_VIEW": {"dwell_ms": "0"}, "SEARCH": {"results": "0", "filters": "{}"}, "ADD_TO_CART": {"quantity": "1"}, "REMOVE_FROM_CART": {"quantity": "1"},
    "PURCHASE": {"quantity": "1"}, "PRODUCT_SHARE": {"channel": "link"}, "PRODUCT_REVIEW": {"length": "0"}, "SESSION_START": {"entry": "direct"}, "SESSION_END": {"entry": "direct"},
}
EARLY_MINUTES, LATE_DAYS = 5, 7


def _broken(value: Column, kind: str, least, most) -> Column:
    if kind == "any":
        return F.lit(False)
    measure = F.length(value) if kind == "text" else F.expr("0.0") + value.try_cast("double")
    wrong = measure.isNull() if kind != "text" else F.lit(False)
    if kind == "int":
        wrong = wrong | (measure != F.floor(measure))
    if least is not None:
        wrong = wrong | (measure < least)
    if most is not None:
        wrong = wrong | (measure > most)
    return F.coalesce(wrong, F.lit(True))


def payload_reasons(event_type: Column, payload: Column, rules: dict | None = None) -> Column:
    """What is wrong with ``payload`` (a map of texts): unknown keys, missing keys, values out of range."""
    rules = PAYLOAD_RULES if rules is None else rules
    out = F.array().cast("array<string>")
    for kind, spec in rules.items():
        extra = F.size(F.array_except(F.map_keys(payload), F.array(*[F.lit(k) for k in spec]).cast("array<string>"))) > 0
        checks = [F.when(extra, F.lit("unknown_key"))]
        checks += [F.when(payload[k].isNotNull() & _broken(payload[k], *s), F.lit(f"bad_{k}")) for k, s in spec.items()]
        checks += [F.when(payload[k].isNull(), F.lit(f"missing_{k}")) for k in REQUIRED.get(kind, ())]
        out = F.when(event_type == kind, F.array_compact(F.array(*checks))).otherwise(out)
    return out


def normal_payload(event_type: Column, payload: Column) -> Column:
    """``payload`` without nulls, and with the defaults of its type."""
    kept = F.map_filter(payload, lambda k, v: v.isNotNull())
    out = kept
    for kind, spec in DEFAULTS.items():
        given = F.create_map(*[F.lit(x) for pair in spec.items() for x in pair])
        missing = F.map_filter(given, lambda k, v: ~F.map_contains_key(kept, k))
        out = F.when(event_type == kind, F.map_concat(kept, missing)).otherwise(out)
    return out


def validate(events: DataFrame, now: Column, rules: dict | None = None) -> DataFrame:
    """``events`` with their bounded time, decoded payload and ``reasons`` (empty: accepted).

    Times up to ``EARLY_MINUTES`` ahead pass, later ones are set to ``now``; those older than
    ``LATE_DAYS`` are rejected; a missing one is ``now``.
    """
    at, kind = F.col("occurred_at"), F.col("event_type")
    payload = F.from_json("event_metadata", "map<string,string>")
    payload = F.when(F.col("event_metadata").isNull(), F.create_map().cast("map<string,string>")).otherwise(payload)
    scoped = kind.isin(*SCOPED_TYPES)
    df = events.withColumn("payload", payload)
    reasons = F.array_compact(
        F.array(
            F.when(kind.isNull() | ~kind.isin(*EVENT_TYPES), F.lit("unknown_type")),
            F.when(F.col("session_key").isNull() | ~F.length("session_key").between(8, 64), F.lit("bad_session_key")),
            F.when(F.col("product_id") <= 0, F.lit("bad_product_id")),
            F.when(F.length("source") > 64, F.lit("bad_source")),
            F.when(at < now - F.expr(f"interval {LATE_DAYS} days"), F.lit("too_old")),
            F.when(scoped & F.col("product_id").isNull(), F.lit("missing_product")),
            F.when(kind.isin(*UNSCOPED_TYPES) & F.col("product_id").isNotNull(), F.lit("needless_product")),
            F.when(F.col("payload").isNull(), F.lit("bad_payload")),
        )
    )
    bounded = F.when(at > now + F.expr(f"interval {EARLY_MINUTES} minutes"), now).otherwise(F.coalesce(at, now))
    return df.withColumn("reasons", F.concat(reasons, payload_reasons(kind, F.coalesce("payload", F.create_map().cast("map<string,string>")), rules))).withColumn("occurred_at", bounded).withColumn("payload", normal_payload(kind, F.col("payload")))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") == 0).drop("reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") > 0)


def accounting(validated: DataFrame, by: list[str]) -> DataFrame:
    """Accepted and rejected events of each batch (or other key)."""
    bad = F.size("reasons") > 0
    return validated.groupBy(*by).agg(F.sum((~bad).cast("long")).alias("accepted"), F.sum(bad.cast("long")).alias("rejected"))


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def attribute_users(events: DataFrame, principals: DataFrame) -> DataFrame:
    """The user comes from the trusted ``session_key -> user_id`` table, whatever the event says."""
    trusted = principals.groupBy("session_key").agg(F.min("user_id").alias("user_id"))
    return events.drop("user_id").join(trusted, "session_key", "left")


def high_signal_users(events: DataFrame) -> DataFrame:
    """Users whose lists must be made anew."""
    return events.filter(F.col("event_type").isin(*REFRESH_TYPES) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.unix_micros(F.max("occurred_at")).alias("last_us"))
