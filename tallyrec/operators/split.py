"""Temporal split and leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrec.functions.columns import mapped

FOLD_ORDER = ("train", "validation", "test")


#: Widths, in microseconds, by which a position is narrowed down: hours, seconds, moments.
WIDTHS = (3_600_000_000, 1_000_000, 1)


def time_at(rows: DataFrame, fractions: list[float], column: str = "occurred_at") -> list[int]:
    """The times (microseconds) at position ``round((n - 1) * q)`` of the sorted times.

    Three passes of counts, each over all positions at once: by hour, by second of the hours that hold a position,
    by moment of those seconds.  The driver sees a row an hour, then at most 3600 and a second's moments for each position.
    """
    micros = rows.filter(F.col(column).isNotNull()).select(F.unix_micros(column).alias("at"))
    inside, places = micros, None
    for width in WIDTHS:
        counts = sorted((r["step"], r["count"]) for r in inside.groupBy(F.floor(F.col("at") / width).alias("step")).count().collect())
        if places is None:
            total = sum(n for _, n in counts)
            if not total:
                raise ValueError("there are no interactions to split")
            places = [(round((total - 1) * q), None) for q in fractions]
        found = []
        for position, (lo, hi) in ((p, span or (None, None)) for p, span in places):
            for step, n in counts:
                if lo is not None and not lo <= step * width < hi:
                    continue
                if position < n:
                    break
                position -= n
            found.append((position, (step * width, (step + 1) * width)))
        places = found
        held = F.lit(False)
        for _, (lo, hi) in places:
            held = held | ((F.col("at") >= lo) & (F.col("at") < hi))
        inside = micros.filter(held)
    return [lo for _, (lo, _) in places]


def split_temporal(rows: DataFrame, train: float = 0.70, validation: float = 0.15, times: DataFrame | None = None) -> DataFrame:
    """``rows`` with their ``fold``: train before the first boundary, test from the second on.

    ``times`` may give the same ``occurred_at`` from a plainer table, so that what ``rows`` is joined from isn't read for them.
    """
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions must be positive and leave something for the test fold")
    first, second = time_at(rows if times is None else times, [train, train + validation])
    at = F.unix_micros("occurred_at")
    return rows.withColumn("fold", F.when(at < first, "train").when(at < second, "validation").otherwise("test"))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("items"), F.unix_micros(F.min("occurred_at")).alias("first_us"), F.unix_micros(F.max("occurred_at")).alias("last_us"))


def fold_order(folds: DataFrame) -> DataFrame:
    """``fold, next_fold, in_order`` for folds that are there and next to one another."""
    follows = mapped(F.col("fold"), dict(zip(FOLD_ORDER, FOLD_ORDER[1:], strict=False)))
    ends = folds.groupBy("fold").agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    after = ends.select(F.col("fold").alias("next_fold"), F.col("lo").alias("next_lo"))
    return ends.withColumn("next_fold", follows).join(after, "next_fold").select("fold", "next_fold", (F.col("hi") < F.col("next_lo")).alias("in_order"))


def assert_no_leakage(folds: DataFrame) -> None:
    """Raise unless all folds are there and follow one another in time."""
    found = {r["fold"]: r["in_order"] for r in fold_order(folds).collect()}
    if set(found) != set(FOLD_ORDER[:-1]):
        raise ValueError(f"folds are missing: only {sorted(found)} are followed by their next one")
    late = [fold for fold, fine in found.items() if not fine]
    if late:
        raise ValueError(f"{late} reach into the folds after them")


def rows_after(rows: DataFrame, as_of: Column, column: str = "occurred_at") -> DataFrame:
    """``n``: how many rows are at or after ``as_of``."""
    return rows.filter(F.col(column) >= as_of).agg(F.count(F.lit(1)).alias("n"))


def assert_before(rows: DataFrame, as_of: Column, column: str = "occurred_at") -> None:
    """Raise if any row is at or after ``as_of``."""
    if rows.filter(F.col(column) >= as_of).limit(1).count():
        raise ValueError("rows at or after the cut-off would leak the future")


def targets(folds: DataFrame, fold: str, types: tuple[str, ...] = ("PURCHASE", "ADD_TO_CART", "PRODUCT_CLICK")) -> DataFrame:
    """What each user really went on to do: distinct (user, product)."""
    return folds.filter((F.col("fold") == fold) & F.col("event_type").isin(*types)).select("user_id", "product_id").distinct()


def eligible_users(folds: DataFrame, fold: str, least: int = 3) -> DataFrame:
    """Users of ``fold`` with at least ``least`` interactions in train."""
    enough = folds.filter("fold = 'train'").groupBy("user_id").count().filter(F.col("count") >= least).select("user_id")
    return folds.filter(F.col("fold") == fold).select("user_id").distinct().join(enough, "user_id", "left_semi")
