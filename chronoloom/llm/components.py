"""Connected components of a table of links, without moving links to the driver.

Large-star and small-star steps alternate until nothing changes; both only take
a minimum per node and join it back to the links, so a node with very many links
is pre-aggregated before the shuffle and its links are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the least node that links lead to), for nodes that are not their own component.

    ``links`` holds pairs of comparable ids in columns ``a`` and ``b``, in any
    direction, repeated or to themselves. No links give no row.
    """
    e = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        e = cut_lineage(_small_star(_large_star(e)))
