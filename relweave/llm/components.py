"""Connected components of a table of links, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link.

    Alternates large-star and small-star steps (every node links its larger, then its smaller
    neighbours to the smallest one), which keeps the table at one row per link and ends after about the
    logarithm of the longest path. Each step is written; a hot node is reduced before it is shuffled.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count()
        over = not changed and after.count() == edges.count()
        for done in (least, large, low, after if over else edges):
            discard(done)
        if over:
            break
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialize(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()))
    discard(edges)
    return out
