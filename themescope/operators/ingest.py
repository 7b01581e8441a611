"""Arrival-order operators: length filter, per-type quota, paging stop, dedup.

Arrival order is semantic in the reference (keep-first dedup, quota, first
sample), so every operator here orders by the explicit ``ord`` column and
never by scan order.  Top-n-per-group windows use ``row_number() <= n``
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle, so a
hot group (one tag or id holding a third of the rows) is cut down map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.sources.hits import MIN_TEXT_CHARS

GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_n_per_group(df: DataFrame, group: str | list[str], n: int,
                      order: list | None = None, rank_col: str | None = None) -> DataFrame:
    """Rows with the ``n`` smallest ``order`` values in each group.

    Spark cuts groups before the shuffle only up to a threshold of ``n``; the
    session's is raised to ``n`` where it is lower.
    """
    group = [group] if isinstance(group, str) else list(group)
    conf = df.sparkSession.conf
    if n > int(conf.get(GROUP_LIMIT_CONF, "1000")):
        conf.set(GROUP_LIMIT_CONF, str(n))
    w = Window.partitionBy(*group).orderBy(*(order or ["ord"]))
    rc = rank_col or "_rn"
    out = df.withColumn(rc, F.row_number().over(w)).where(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)


def length_counts(posts_unfiltered: DataFrame, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Per content type: hits seen, kept (≥ min_chars) and dropped as too short."""
    short = F.length("text") < min_chars
    return posts_unfiltered.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count(F.when(~short, 1)).alias("n_kept"),
        F.count(F.when(short, 1)).alias("n_short"))


def type_quota(posts: DataFrame, max_results: int) -> DataFrame:
    """First ``max_results // 2`` surviving rows of *each* content type.

    Counted after the length filter and before dedup, as in the reference;
    an odd ``max_results`` therefore loses one row.
    """
    return first_n_per_group(posts, "content_type", max_results // 2)


def dedup_first(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Keep the first row (by ``order``) of every key; null keys form one group."""
    return first_n_per_group(df, key, 1, [order])


def stop_pages(hits: DataFrame) -> DataFrame:
    """(content_type, stop_page): the first page number with no hits.

    The scan of one tag stops at its first empty page.  A page p is the
    first empty one when p (or p = 0) is missing and every smaller page is
    present; computed with anti-joins and a partial ``min`` so no tag's pages
    are ever gathered into one task.
    """
    present = hits.select("content_type", "page").distinct()
    candidates = (present.select("content_type", (F.col("page") + 1).alias("page"))
                  .unionByName(present.select("content_type", F.lit(0).alias("page")))
                  .distinct())
    missing = candidates.join(present, ["content_type", "page"], "left_anti")
    return missing.groupBy("content_type").agg(F.min("page").alias("stop_page"))


def pages_before_stop(hits: DataFrame) -> DataFrame:
    """Hits the paging loop reaches: pages before the first empty page.

    ``stops`` has one row per tag and is sent to the hits: an exchange by tag
    would bring all hits of a tag into one task.
    """
    stops = F.broadcast(stop_pages(hits))
    return (hits.join(stops, "content_type")
            .where(F.col("page") < F.col("stop_page")).drop("stop_page"))


def dataset_gate(df: DataFrame, min_posts: int, key: str = "dataset") -> DataFrame:
    """Rows of datasets with at least ``min_posts`` rows (left semi join on the
    per-dataset counts; ``left_anti`` with the same counts gives the rejects)."""
    ok = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_posts)
    return df.join(ok.select(key), key, "left_semi")


def dataset_rejects(df: DataFrame, min_posts: int, key: str = "dataset") -> DataFrame:
    ok = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_posts)
    return df.join(ok.select(key), key, "left_anti")
