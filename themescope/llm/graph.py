"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import written


def _hang(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair u -> v with m, the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the least
    node that can be reached.  Ids are longs and not null; loops, repeated and
    reversed links do no harm; no links, no rows.

    Alternating large-star and small-star steps: each hangs partners below the
    least one, so the number of links never grows and about log(n) rounds are
    needed.  Every round is written, which cuts the lineage.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # u > v in every pair now: partners of u are all smaller than u.
        hung = _hang(large)
        small = (hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
