"""URL rules found by hash prefix.

Each distinct (host, path) is expanded into its host suffixes and those path
prefixes whose length some rule has; their digests meet the rules' in an equi-join
on a short prefix, and the full digest then confirms the match.  Of the rules that
fit, the longest (host and path together) wins; then the longer host; then block.

Cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits; such pages, and pages that no rule fits, get ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares.
SHORT = 8
#: Rules up to this many are sent to every task; beyond it the join shuffles both sides.
BROADCAST_RULES = 100_000

RULES = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = rest.substr(F.length(host) + 1, F.length(rest))
    return F.when(known, lowered).otherwise(""), F.when(known, path).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    # A host holds no "/", so host and path can be told apart in what is hashed.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct ``(host, path)`` that has one."""
    spec = rules.select("host", "path", "verdict").distinct().select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    spec = spec.withColumn("short", F.substring("rule_digest", 1, SHORT))
    lengths = [r[0] for r in spec.select(F.length("rule_path")).distinct().collect()]
    if spec.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        spec = F.broadcast(spec)

    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    opened = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    opened = opened.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, SHORT))
    found = opened.join(spec, "short").filter("digest = rule_digest")
    size = F.length("rule_host") + F.length("rule_path")
    best = F.max_by(F.struct("rule_host", "rule_path", "verdict"), F.struct(size, F.length("rule_host"), F.col("verdict") == "block"))
    return found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    return urls.join(match_rules(urls, rules), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
