"""Connected components of a table of links, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then every
node and its smaller neighbours. The links end as stars around the smallest
node of each component. Rounds grow with the logarithm of the longest path;
every round is written, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_least")).select("u", F.least("u", "_least").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links with u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to. links: u, v. Nodes without links don't appear."""
    up = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stage(links.filter(F.col("u") != F.col("v")).select(*up).distinct(), "links")
    while True:
        following = stage(_small_star(_large_star(now).distinct()).distinct(), "links")
        # Both are sets of links: equal counts and no new one mean that nothing moved.
        if now.count() == following.count() and following.join(now, ["u", "v"], "left_anti").isEmpty():
            break
        now = following
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
