"""Theme drift over time (DRF-1..4, ORD-8): shares per tumbling period,
share change, centre movement and Jensen–Shannon distance between periods.

Periods are ``window(created_at, period)`` buckets (aligned to the epoch, as
DuckDB's ``time_bucket(…, timestamp '1970-01-01')``).  The (period, cluster)
grid is built per cluster with ``sequence`` between the global first and last
period, which are scalar subqueries — no cross join.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.functions.vector import cosine

DEFAULT_PERIOD = "7 days"


def _period(df: DataFrame, period: str, ts: str = "created_at") -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), period)
    return df.withColumn("period_start", w.start)


def drift_timeline(clustered: DataFrame, period: str = DEFAULT_PERIOD) -> DataFrame:
    """(period_start, cluster, n_posts, share) — share within the period."""
    counts = (_period(clustered, period).groupBy("period_start", "cluster")
              .agg(F.count(F.lit(1)).alias("n_posts")))
    totals = counts.groupBy("period_start").agg(F.sum("n_posts").alias("_t"))
    return (counts.join(totals, "period_start")
            .withColumn("share", F.col("n_posts") / F.col("_t")).drop("_t"))


def period_grid(timeline: DataFrame, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Every (period_start, cluster) between the first and last period."""
    first = timeline.select(F.min("period_start")).scalar()
    last = timeline.select(F.max("period_start")).scalar()
    clusters = timeline.select("cluster").distinct()
    step = F.expr(f"INTERVAL {period}")
    return clusters.select("cluster", F.explode(F.sequence(first, last, step)).alias("period_start"))


def drift_delta(clustered: DataFrame, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Share and its change from the previous period, absent pairs as 0."""
    tl = drift_timeline(clustered, period)
    grid = period_grid(tl, period)
    full = (grid.join(tl, ["period_start", "cluster"], "left")
            .select("period_start", "cluster", F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
                    F.coalesce("share", F.lit(0.0)).alias("share")))
    w = Window.partitionBy("cluster").orderBy("period_start")
    prev = F.lag("share").over(w)
    return full.withColumn("prev_share", prev).withColumn("delta", F.col("share") - F.col("prev_share"))


def centroid_shift(clustered_vec: DataFrame, period: str = DEFAULT_PERIOD,
                   vec_col: str = "embedding") -> DataFrame:
    """Mean vector per (period, cluster) and its cosine distance to the same
    cluster's mean in the previous period present."""
    p = _period(clustered_vec, period)
    means = _means(p, vec_col)
    w = Window.partitionBy("cluster").orderBy("period_start")
    prev = means.withColumn("prev_start", F.lag("period_start").over(w))
    a = prev.alias("a")
    b = means.select(F.col("cluster"), F.col("period_start").alias("prev_start"),
                     F.col("center").alias("prev_center")).alias("b")
    j = a.join(b, ["cluster", "prev_start"])
    return j.select("period_start", "prev_start", "cluster",
                    (1 - cosine(F.col("center"), F.col("prev_center"))).alias("shift"))


def _means(p: DataFrame, vec_col: str) -> DataFrame:
    v = p.select("period_start", "cluster", array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    m = v.groupBy("period_start", "cluster").agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select("period_start", "cluster", vector_to_array("_m").alias("center"))


def drift_jsd(clustered: DataFrame, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Jensen–Shannon divergence (natural log) between consecutive periods'
    cluster distributions; 0·ln 0 = 0."""
    d = drift_delta(clustered, period).where(F.col("prev_share").isNotNull())
    p, q = F.col("prev_share"), F.col("share")
    m = (p + q) / 2
    term = (F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)) / 2
    return d.groupBy("period_start").agg(F.sum(term).alias("jsd"))
