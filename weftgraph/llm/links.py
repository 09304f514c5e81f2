"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reached, for each node of a link; linked nodes only.

    Alternates large-star and small-star rounds, whose number grows with the logarithm of the
    longest chain; every round is a shuffle on a node with map-side minimum, and is cut to the
    shared folder. Null ends are left out.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).dropna().where("u <> v").distinct())
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        # large star: each node's larger neighbours link to its least neighbour
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        # small star: each node's smaller neighbours, and itself, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
