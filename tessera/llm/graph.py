"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared


#: Links of a node above which it is a hub: a share of all links, so that there are few hubs.
HUB_LINKS, MOST_HUBS = 10_000, 100_000


def lowered(links: DataFrame, low: DataFrame, hub_links: int) -> DataFrame:
    """links(u, v) with m of low(u, m, n), n being the number of links of u; a hub has over `hub_links`.

    The links of a hub meet m by a broadcast of the hubs (at most a row for each `hub_links` links),
    all others by a shuffle, so no node's links are gathered in one task.
    """
    if not low.where(F.col("n") > hub_links).limit(1).count():
        return links.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.where(F.col("n") > hub_links).select("u", "m"))
    return links.join(hubs, "u").unionByName(links.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= hub_links).select("u", "m"), "u"))


def components(links: DataFrame, name: str = "components", hub_links: int = HUB_LINKS) -> DataFrame:
    """node, root for every node that links(a, b) name; root is the smallest node of its component.

    Each round is written to shared storage, and the one before deleted. The rounds needed grow with the
    logarithm of the longest chain.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = shared.store(edges, name)
    before = None
    while True:
        size = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (size["n"], size["h"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (size["n"], size["h"])
        limit = max(hub_links, 2 * size["n"] // MOST_HUBS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = lowered(both, low, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = shared.store(large, name)
        shared.drop(spark, path)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lowered(large, low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, path = shared.store(small, name)
        shared.drop(spark, large_path)
