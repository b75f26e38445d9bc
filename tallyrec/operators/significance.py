"""Significance tests and experiment assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import chi_square_tail, normal_cdf, ratio, stable_bucket

Z95 = 1.959963985


def _resampled_means(values: DataFrame, keys: list[str], resamples: int, blocks: int, seed: int = 1) -> DataFrame:
    """``keys, resample, m``: the mean of each Poisson resample of ``values (keys, d, n)``, where ``d`` occurred ``n`` times.

    Values are dealt out to ``blocks`` tasks.  A task draws the numbers of each value from a stream
    that the value itself seeds (so a task that runs again draws the same) and hands on one sum for each resample.
    """
    names = [*keys, "seed", "d", "n"]
    seeded = values.withColumn("seed", F.xxhash64(F.lit(seed), *keys, "d")).select(*names).repartition(blocks, *keys, "d")
    schema = ", ".join([f"{k} {values.schema[k].dataType.simpleString()}" for k in keys] + ["resample int", "w double", "wd double"])

    def draw(batches):
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for frame in batches:
            columns = [frame[k].tolist() for k in names]
            for *key, own, d, n in zip(*columns, strict=True):
                w, wd = sums.setdefault(tuple(key), (np.zeros(resamples), np.zeros(resamples)))
                drawn = np.random.Generator(np.random.Philox(key=own & (2**64 - 1))).poisson(n, resamples)
                w += drawn
                wd += drawn * d
        for key, (w, wd) in sums.items():
            yield pd.DataFrame({**{k: [v] * resamples for k, v in zip(keys, key, strict=True)}, "resample": range(resamples), "w": w, "wd": wd})

    parts = seeded.mapInPandas(draw, schema)
    return parts.groupBy(*keys, "resample").agg(F.try_divide(F.sum("wd"), F.sum("w")).alias("m"))


def paired_bootstrap(scores: DataFrame, a: str, b: str, metric: str = "ndcg", resamples: int = 5000, blocks: int = 20) -> DataFrame:
    """Poisson bootstrap of the mean difference ``b - a`` over users.

    Equal differences are counted first; a difference that occurred ``n`` times weighs a Poisson
    number of mean ``n`` in each resample (the sum of its users' own draws), so the work depends on the number of
    distinct differences, not of users, and is spread over ``blocks`` tasks.
    """
    wide = scores.filter(F.col("model").isin(a, b)).groupBy("user_id").agg(*[F.max(F.when(F.col("model") == m, F.col(metric))).alias(n) for m, n in ((a, "x"), (b, "y"))]).dropna()
    diffs = wide.groupBy(F.round(F.col("y") - F.col("x"), 9).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = _resampled_means(diffs, [], resamples, blocks)
    seen = diffs.agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("difference"), F.sum("n").alias("users"))
    out = each.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.sum((F.col("m") <= 0).cast("int")).alias("below"), F.sum((F.col("m") >= 0).cast("int")).alias("above"))
    p = F.least(F.lit(1.0), 2.0 * (F.least("below", "above") + 1) / (resamples + 1))
    return seen.crossJoin(out).select("difference", "users", "low", "high", p.alias("p_value"))


def two_proportions(df: DataFrame, x1="x1", n1="n1", x2="x2", n2="n2") -> DataFrame:
    """Pooled z test and unpooled 95 % interval of ``x2 / n2 - x1 / n1``."""
    c = {k: F.col(k).cast("double") for k in (x1, n1, x2, n2)}
    p1, p2 = ratio(c[x1], c[n1]), ratio(c[x2], c[n2])
    pooled = ratio(c[x1] + c[x2], c[n1] + c[n2])
    wide = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1.0), c[n1]) + ratio(F.lit(1.0), c[n2])))
    own = F.sqrt(ratio(p1 * (1 - p1), c[n1]) + ratio(p2 * (1 - p2), c[n2]))
    z = ratio(p2 - p1, wide)
    df = df.withColumns({"rate_1": p1, "rate_2": p2, "difference": p2 - p1, "z": z, "low": p2 - p1 - Z95 * own, "high": p2 - p1 + Z95 * own})
    return df.withColumn("p_value", F.when(wide > 0, 2 * (1 - normal_cdf(F.abs("z")))).otherwise(1.0)).withColumn("significant", F.col("p_value") < 0.05)


def sample_ratio(arms: DataFrame) -> DataFrame:
    """Chi-square test of observed ``n`` against ``expected_share`` for any number of arms; no traffic, or one arm, gives p = 1."""
    totals = arms.agg(F.sum("n").cast("double").alias("total"))
    expected = F.col("total") * F.col("expected_share")
    parts = arms.crossJoin(F.broadcast(totals)).agg(F.sum(ratio(F.pow(F.col("n") - expected, 2), expected)).alias("chi_square"), F.first("total").alias("total"), F.count(F.lit(1)).cast("int").alias("arms"))
    p = F.when(F.col("total") > 0, chi_square_tail(F.col("chi_square"), F.col("arms") - 1)).otherwise(1.0)
    return parts.select("chi_square", p.alias("p_value"), (p < 0.001).alias("mismatch"))


def mean_interval(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """Mean of each arm's users with its normal 95 % interval."""
    half = Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(arm).agg(F.count(value).alias("users"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def mean_bootstrap(rows: DataFrame, arm: str, value: str, resamples: int = 2000, blocks: int = 20) -> DataFrame:
    """Mean of each arm's users with its bootstrapped 95 % interval, for skewed values as revenue."""
    counts = rows.groupBy(arm, F.round(F.col(value), 9).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n")).dropna()
    spans = _resampled_means(counts, [arm], resamples, blocks).groupBy(arm).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    means = counts.groupBy(arm).agg(F.sum("n").cast("long").alias("users"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("mean"))
    return means.join(spans, arm).select(arm, "users", "mean", "low", "high")


def variant_ranges(experiments: DataFrame) -> DataFrame:
    """``key, variant, low, high`` by running sums of allocations; experiments that don't sum to one are left out.

    ``experiments (key, status, holdout, variants array<struct<name, allocation>>)``.
    """
    total = F.aggregate("variants", F.lit(0.0), lambda a, v: a + v["allocation"])
    good = experiments.filter(F.col("variants").isNotNull() & (F.abs(total - 1) < 1e-6))
    opened = good.select("key", "status", "holdout", F.posexplode("variants").alias("at", "v"))
    w = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    high = F.sum("v.allocation").over(w)
    return opened.select("key", "status", "holdout", F.col("v.name").alias("variant"), F.round(high - F.col("v.allocation"), 9).alias("low"), F.round(high, 9).alias("high"))


def assign(subjects: DataFrame, experiments: DataFrame, subject: str = "subject") -> DataFrame:
    """Variant of each subject in each running experiment; the holdout is drawn with a salt of its own.

    Experiments are few by nature and are sent to every task.
    """
    spans = variant_ranges(experiments).filter("status = 'running'")
    listed = spans.groupBy("key", "holdout").agg(F.array_sort(F.collect_list(F.struct("high", "variant"))).alias("spans"))
    met = subjects.select(F.col(subject).cast("string").alias("subject")).crossJoin(F.broadcast(listed))
    place = stable_bucket(F.concat_ws(":", "key", "subject")) / 10_000.0
    held = stable_bucket(F.concat_ws(":", F.col("key"), F.lit("holdout"), F.col("subject"))) / 10_000.0 < F.col("holdout")
    first = F.element_at(F.filter("spans", lambda s: place < s["high"]), 1)["variant"]
    return met.select("subject", "key", F.when(held, "holdout").otherwise(first).alias("variant"))


def merge_configs(assigned: DataFrame, configs: DataFrame) -> DataFrame:
    """One map of settings for each subject; a later key (by name) wins."""
    met = assigned.join(configs.select("key", "variant", "config"), ["key", "variant"])
    settings = met.select("subject", "key", F.explode("config").alias("name", "value")).groupBy("subject", "name").agg(F.max_by("value", "key").alias("value"))
    return settings.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("config"))


def parse_experiments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, malformed) definitions of ``key, status, holdout, definition`` (JSON)."""
    parsed = raw.withColumn("variants", F.from_json("definition", "array<struct<name:string,allocation:double,config:map<string,string>>>"))
    total = F.aggregate("variants", F.lit(0.0), lambda a, v: a + F.coalesce(v["allocation"], F.lit(-1.0)))
    good = F.coalesce(F.abs(total - 1) < 1e-6, F.lit(False))
    return parsed.filter(good), parsed.filter(~good)


def exposures(rows: DataFrame) -> DataFrame:
    """First exposure of each subject to each experiment."""
    return rows.groupBy("key", "subject").agg(F.unix_micros(F.min("occurred_at")).alias("first_us"), F.min_by("variant", "occurred_at").alias("variant"))


def bucket_of(key: Column) -> Column:
    return stable_bucket(key)
