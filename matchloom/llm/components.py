"""Connected components by alternating stars, cut at written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.plans.durable import measured, spool


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest of them; the rounds
    needed grow with the logarithm of the number of nodes. The smallest neighbour is combined on the map side and
    joined back, so a hub's links never meet in one group.
    """
    pairs = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = spool(pairs.distinct(), "links"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = measured(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = measured(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = spool(small.distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
