"""Items seen or bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.functions.columns import minmax_within, top_k
from tallyrec.session import checkpointed


#: Items of a basket that are paired in one task.
BLOCK = 512
#: Rows that a task takes of an exchange by basket or by pair.
DEALT = 1_000_000


def _dealt(df: DataFrame, rows: float, *columns: str) -> DataFrame:
    """``df`` dealt over more tasks than the session's exchanges have, where ``rows`` would leave more than ``DEALT`` to one."""
    tasks = int(-(-rows // DEALT))
    return df.repartition(tasks, *columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def neighbours(baskets: DataFrame, *, least: int, most: int | None, min_support: int, k: int, rows: int | None = None) -> DataFrame:
    """Directed neighbour edges of ``baskets (basket, product_id)`` by lift.

    Baskets outside ``least`` to ``most`` distinct items count neither as pairs nor in the totals.
    Without ``most``, baskets of one item still count in the totals.  Items below the
    support can't be in a pair that reaches it, so they are left out of the self-join.  A basket of more
    than ``BLOCK`` items is joined block by block, so that its pairs are spread over many tasks.  Tasks grow in
    number with the rows (``rows`` of ``baskets``, where they are many) and the pairs, so that none grows with them.
    """
    # dealt out by basket once: both the distinct items and a basket's size are found there
    dealt = _dealt(baskets.select("basket", "product_id").repartition("basket"), rows or 0, "basket")
    sized = dealt.distinct().withColumn("n", F.count(F.lit(1)).over(W.partitionBy("basket")))
    items = checkpointed(sized.filter(F.col("n").between(least, most) if most is not None else F.col("n") >= least))
    # of each basket size: so many rows, each an nth of a basket, with half of the others as its pairs
    sizes = items.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    total, n_items, n_pairs = (x or 0.0 for x in sizes.agg(F.sum(F.col("rows") / F.col("n")), F.sum("rows"), F.sum(F.col("rows") * (F.col("n") - 1) / 2)).first())
    marginals = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_item"))
    frequent = items.join(marginals.filter(F.col("n_item") >= min_support).select("product_id"), "product_id", "left_semi").withColumn("last", (F.floor((F.col("n") - 1) / BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("product_id"), F.col("last") + 1).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("last")))
    left = frequent.select("basket", F.col("product_id").alias("x"), F.col("block").alias("bx"), every.alias("by"))
    right = frequent.select("basket", F.col("product_id").alias("y"), F.col("block").alias("by"), every.alias("bx"))
    met = ("basket", "bx", "by")
    pairs = _dealt(left, n_items, *met).join(_dealt(right, n_items, *met), list(met)).filter(F.col("x") < F.col("y"))
    pairs = _dealt(pairs, n_pairs, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    both = pairs.join(marginals.select(F.col("product_id").alias("x"), F.col("n_item").alias("n_x")), "x").join(marginals.select(F.col("product_id").alias("y"), F.col("n_item").alias("n_y")), "y")
    lifted = both.withColumn("lift", F.col("support") * F.lit(total) / (F.col("n_x") * F.col("n_y")))
    mirrored = lifted.select(F.explode(F.array(F.struct(F.col("x").alias("item"), F.col("y").alias("neighbour")), F.struct(F.col("y").alias("item"), F.col("x").alias("neighbour")))).alias("e"), "lift", "support").select("e.*", "lift", "support")
    return top_k(mirrored, ["item"], "lift", "neighbour", k)


def covisited(rows: DataFrame, min_support: int = 3, k: int = 60, most: int = 30) -> DataFrame:
    looked = rows.filter(F.col("event_type").isin("PRODUCT_VIEW", "PRODUCT_CLICK")).select(F.col("session_key").alias("basket"), "product_id")
    return neighbours(looked, least=2, most=most, min_support=min_support, k=k)


def bought_together(items: DataFrame, min_support: int = 2, k: int = 30) -> DataFrame:
    return neighbours(items.select(F.col("order_id").alias("basket"), "product_id"), least=1, most=None, min_support=min_support, k=k, rows=items.count())


def recommend(recent: DataFrame, edges: DataFrame, seen: DataFrame, k: int, *, anchors: int = 20, decay: float = 0.85, how: str = "sum") -> DataFrame:
    """From each user's latest ``anchors`` (``rank`` from 1): ``decay ** position`` times lift, summed, or the largest."""
    start = recent.filter(F.col("rank") <= anchors).select("user_id", F.col("product_id").alias("item"), F.pow(F.lit(decay), F.col("rank") - 1).alias("share"))
    met = start.join(edges.select("item", "neighbour", "lift"), "item")
    part = F.col("share") * F.col("lift") if how == "sum" else F.col("lift")
    scored = met.groupBy("user_id", F.col("neighbour").alias("product_id")).agg((F.sum(part) if how == "sum" else F.max(part)).alias("score"))
    fresh = scored.join(seen.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")
    return top_k(fresh, ["user_id"], "score", "product_id", k).withColumn("score", minmax_within(F.col("score"), ["user_id"]))
