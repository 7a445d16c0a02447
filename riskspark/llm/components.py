"""Connected components of a table of links, by alternating star contractions.

Every round is aggregation and equi-join only, so a hub with a third of all links is combined map-side and its
join can be split at run time. Each half round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.scratch import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are hung under the smallest of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, are hung under the smallest of them (links have a < b)."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select("m", "b")).toDF("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) for every node of the links (a, b); self links and nulls are ignored."""
    cleaned = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, before = stored(cleaned), None
    while True:
        links = stored(_small_star(stored(_large_star(links))))
        # Ended when every node hangs under one root that hangs under none, and nothing changed.
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a").distinct())
        before = (now["n"], now["h"])
