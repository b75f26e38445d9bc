"""Drift, promotion gate and the retraining decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-6
ALERT, WARNING = 0.25, 0.10


def stacked(frame: DataFrame, features: list[str]) -> DataFrame:
    """``feature, value`` of several columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return frame.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")


def severity(psi):
    return F.when(psi >= ALERT, "alert").when(psi >= WARNING, "warning").otherwise("ok")


def psi_numeric(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index of each feature of two stacked tables.

    Bins are the reference's quantiles, equal edges once, open at both ends; shares are at least 1e-6;
    features without two edges have 0.
    """
    qs = [i / bins for i in range(bins + 1)]
    edges = reference.groupBy("feature").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(q) for q in qs]))).alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    edges = edges.select("feature", inner.alias("inner"), (F.size("edges") - 1).alias("n_bins"))
    both = reference.withColumn("side", F.lit("r")).unionByName(current.withColumn("side", F.lit("c")))
    placed = both.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("feature", "n_bins", "bin").agg(F.sum((F.col("side") == "r").cast("double")).alias("r"), F.sum((F.col("side") == "c").cast("double")).alias("c"))
    every = edges.filter("n_bins >= 1").select("feature", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    filled = every.join(counts.drop("n_bins"), ["feature", "bin"], "left").fillna(0.0, ["r", "c"])
    return _psi(filled, edges.select("feature"))


def psi_categorical(reference: DataFrame, current: DataFrame) -> DataFrame:
    """The same over the union of categories, ``value`` being text."""
    both = reference.withColumn("side", F.lit("r")).unionByName(current.withColumn("side", F.lit("c")))
    counts = both.groupBy("feature", "value").agg(F.sum((F.col("side") == "r").cast("double")).alias("r"), F.sum((F.col("side") == "c").cast("double")).alias("c"))
    return _psi(counts, reference.select("feature").distinct())


def _psi(counts: DataFrame, features: DataFrame) -> DataFrame:
    sums = counts.groupBy("feature").agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    p = F.greatest(F.coalesce(F.try_divide(F.col("r"), F.col("all_r")), F.lit(0.0)), F.lit(FLOOR))
    q = F.greatest(F.coalesce(F.try_divide(F.col("c"), F.col("all_c")), F.lit(0.0)), F.lit(FLOOR))
    found = counts.join(F.broadcast(sums), "feature").groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return features.join(found, "feature", "left").fillna(0.0, ["psi"]).withColumn("severity", severity(F.col("psi")))


def ks_p_value(statistic, n_r, n_c):
    """Asymptotic p-value of a two-sample statistic."""
    root = F.sqrt(n_r * n_c / (n_r + n_c))
    lam = (root + 0.12 + 0.11 / root) * statistic
    series = sum(((-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 8))
    return F.when(statistic <= 0, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def ks(reference: DataFrame, current: DataFrame, parts: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each feature with its asymptotic p-value.

    Equal values are counted first.  A feature's distinct values are dealt out by ``parts`` rough quantiles; running counts go
    over the values of one part, on top of what the parts before it add up to.
    """
    both = reference.withColumn("r", F.lit(1)).withColumn("c", F.lit(0)).unionByName(current.withColumn("r", F.lit(0)).withColumn("c", F.lit(1)))
    values = both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    edges = both.groupBy("feature").agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 1000).alias("edges"))
    dealt = values.join(F.broadcast(edges), "feature").withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    sums = dealt.groupBy("feature", "part").agg(F.sum("r").alias("part_r"), F.sum("c").alias("part_c"))
    # at most ``parts`` rows a feature
    before, whole = W.partitionBy("feature").orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("feature")
    sums = sums.select("feature", "part", *[F.coalesce(F.sum(f"part_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in "rc"], *[F.sum(f"part_{s}").over(whole).alias(f"all_{s}") for s in "rc"])
    upto = W.partitionBy("feature", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    share = lambda s: F.try_divide(F.sum(s).over(upto) + F.col(f"before_{s}"), F.col(f"all_{s}"))
    gaps = dealt.join(F.broadcast(sums), ["feature", "part"]).withColumn("gap", F.abs(share("r") - share("c")))
    found = gaps.groupBy("feature").agg(F.max("gap").alias("ks"), F.sum("r").cast("double").alias("n_r"), F.sum("c").cast("double").alias("n_c"))
    return found.select("feature", "ks", ks_p_value(F.col("ks"), F.col("n_r"), F.col("n_c")).alias("ks_p_value"))


def compare(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """PSI, KS, means and sizes of all ``features`` of two windows, in one table."""
    r, c = stacked(reference, features), stacked(current, features)
    facts = r.groupBy("feature").agg(F.avg("value").alias("reference_mean"), F.count("value").alias("reference_n")).join(c.groupBy("feature").agg(F.avg("value").alias("current_mean"), F.count("value").alias("current_n")), "feature", "full_outer")
    return psi_numeric(r, c).join(ks(r, c), "feature").join(facts, "feature")


def should_retrain(compared: DataFrame) -> DataFrame:
    """Two alerts, or one with three warnings."""
    counts = compared.agg(F.sum((F.col("severity") == "alert").cast("int")).alias("alerts"), F.sum((F.col("severity") == "warning").cast("int")).alias("warnings"))
    return counts.withColumn("retrain", (F.col("alerts") >= 2) | ((F.col("alerts") >= 1) & (F.col("warnings") >= 3)))


#: metric -> (least change against the incumbent, least value or None, advisory).  Fixed values.
GATE = {"ndcg": (0.0, 0.01, False), "recall": (-0.005, None, False), "coverage": (-0.05, 0.05, False), "diversity": (-0.05, None, True), "novelty": (-0.5, None, True)}


def gate(candidate: DataFrame, incumbent: DataFrame, rules: dict | None = None) -> DataFrame:
    """A row for each criterion of ``metric, value`` tables; ``outcome`` is the same in all rows.

    Without an incumbent the candidate is promoted if it reaches the floors.
    """
    rules = GATE if rules is None else rules
    spark = candidate.sparkSession
    plan = spark.createDataFrame([(m, float(d), None if f is None else float(f), a) for m, (d, f, a) in rules.items()], "metric string, min_delta double, floor double, advisory boolean")
    rows = plan.join(candidate.select("metric", F.col("value").alias("candidate")), "metric", "left").join(incumbent.select("metric", F.col("value").alias("incumbent")), "metric", "left")
    rows = rows.withColumn("delta", F.col("candidate") - F.col("incumbent"))
    moved = F.col("incumbent").isNull() | (F.col("delta") >= F.col("min_delta"))
    high = F.col("floor").isNull() | (F.col("candidate") >= F.col("floor"))
    rows = rows.withColumn("passed", F.coalesce(F.col("candidate").isNotNull() & moved & high, F.lit(False)))
    # a handful of criteria, so one task holds them all
    whole = W.partitionBy()
    fine, new = F.min((F.col("passed") | F.col("advisory")).cast("int")).over(whole) == 1, F.max(F.col("incumbent").isNotNull().cast("int")).over(whole) == 0
    return rows.withColumn("outcome", F.when(~fine, "reject").when(new, "promote_first").otherwise("promote"))


def incumbent_of(models: DataFrame) -> DataFrame:
    """The primary model's row, else the one with the best ``ndcg``."""
    return models.orderBy(F.desc(F.coalesce(F.col("is_primary"), F.lit(False)).cast("int")), F.desc("ndcg"), "name").limit(1)


def one_production(versions: DataFrame) -> DataFrame:
    """Names with more than one version in production."""
    return versions.groupBy("name").agg(F.sum((F.col("stage") == "production").cast("int")).alias("n_production")).filter("n_production > 1")
