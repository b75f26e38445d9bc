"""Connected components of links, without gathering them anywhere.

Each round points every node at the smallest node it knows, ties the other smaller
neighbours to that one, and follows the pointers one step (so paths halve).  Rounds
are written to the shared folder, which cuts the lineage; a round's tables go once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.llm.common import drop_staged, stage, staged_so_far


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links (a long, b long)`` that isn't its component's smallest.

    Links to oneself and repeated links change nothing; links with a null end are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct()
    spark, mark = links.sparkSession, staged_so_far()
    edges = stage(edges, "links")
    for _ in range(max_rounds):
        parents = stage(edges.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q")), "parents")
        split = parents.filter("p <> q").limit(1).count()
        deep = edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not split and not deep:
            drop_staged(spark, mark, keep=(parents,))
            return parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        others = edges.join(parents.select("u", "p"), "u").filter("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
        star = others.unionByName(parents.select("u", F.col("p").alias("v")))
        above = parents.select(F.col("u").alias("v"), F.col("p").alias("up"))
        edges = stage(star.join(above, "v", "left").select("u", F.coalesce("up", "v").alias("v")).distinct(), "links")
        drop_staged(spark, mark, keep=(edges,))
    raise RuntimeError("the components did not settle")
