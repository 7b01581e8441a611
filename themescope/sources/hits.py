"""Landed search responses → hits → posts (SRC-1, SRC-2, PRJ-1..7, FLT-1/2, SET-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themescope import schemas
from themescope.functions.text import clean_text, terms

# --- fixed values (the post record written for every hit) ------------------
SOURCE_NAME = "Hacker News"
PLATFORM = "hackernews"
ITEM_URL_PREFIX = "https://news.ycombinator.com/item?id="
MIN_TEXT_CHARS = 40
CONTENT_TYPES = ("story", "comment")
HITS_PER_PAGE = 50
# ---------------------------------------------------------------------------


def read_response_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON response pages (one object per line) with an explicit schema."""
    return spark.read.schema(schemas.RESPONSE_PAGE).json(path)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row per hit, keeping (content_type, page, pos) and an arrival order.

    ``ord`` = type rank · 10^12 + page · 10^6 + position, computed before any
    shuffle, so "first by arrival" stays well defined downstream.
    """
    exploded = pages.select("content_type", "page", F.posexplode("hits").alias("pos", "hit"))
    rank = F.when(F.col("content_type") == CONTENT_TYPES[0], 0).otherwise(1).cast("long")
    return exploded.select(
        "content_type", F.col("page").cast("int").alias("page"), F.col("pos").cast("int").alias("pos"),
        *[F.col(f"hit.{f.name}").alias(f.name) for f in schemas.HIT_FIELDS],
        (rank * 1_000_000_000_000 + F.col("page").cast("long") * 1_000_000
         + F.col("pos").cast("long")).alias("ord"),
    )


def pages_as_json(hits: DataFrame) -> DataFrame:
    """Re-nest flattened hits into response pages serialised as JSON text.

    Each group is one (content_type, page): at most ``HITS_PER_PAGE`` hits, so
    the collected array is bounded however large the corpus is.
    """
    hit = F.struct(F.col("pos"), F.struct(*[f.name for f in schemas.HIT_FIELDS]).alias("h"))
    grouped = hits.groupBy("content_type", "page").agg(F.array_sort(F.collect_list(hit)).alias("hs"))
    body = F.struct("content_type", "page", F.transform("hs", lambda x: x["h"]).alias("hits"))
    return grouped.select(F.to_json(body).alias("json"))


def parse_pages(json_lines: DataFrame, col: str = "json") -> DataFrame:
    """JSON text column → typed response pages (same schema as ``read_response_pages``)."""
    p = json_lines.select(F.from_json(F.col(col), schemas.RESPONSE_PAGE).alias("p"))
    return p.select("p.*")


def post_text(content_type: Column | None = None) -> Column:
    """Story: ``title or ''`` + ' ' + ``story_text or ''``; comment: ``comment_text or ''``."""
    ct = content_type if content_type is not None else F.col("content_type")
    story = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("story_text", F.lit("")))
    return F.when(ct == CONTENT_TYPES[0], story).otherwise(F.coalesce("comment_text", F.lit("")))


def hits_to_posts(hits: DataFrame, min_chars: int = MIN_TEXT_CHARS,
                  source: str = SOURCE_NAME, platform: str = PLATFORM,
                  keep_type: bool = True) -> DataFrame:
    """Hits → post rows: build text, clean it, keep ≥ ``min_chars`` characters.

    Missing time → 1970-01-01 UTC, missing points → 0, null/empty url → the
    item link built from the id.
    """
    h = hits.where(F.col("content_type").isin(*CONTENT_TYPES))
    # Length filter as explode(filter([text], len >= n)): a plain .where on the
    # cleaned text would be pushed below the projection with the whole
    # cleaning expression inlined, running the regex work twice per row.
    kept = F.explode(F.filter(F.array(clean_text(post_text())), lambda t: F.length(t) >= min_chars))
    p = h.select(
        "content_type", "ord",
        F.col("objectID").alias("id"),
        kept.alias("text"),
        F.lit(source).alias("source"),
        F.lit(platform).alias("platform"),
        F.timestamp_seconds(F.coalesce("created_at_i", F.lit(0))).alias("created_at"),
        F.coalesce("points", F.lit(0)).cast("long").alias("score"),
        F.coalesce(F.nullif(F.col("url"), F.lit("")),
                   F.concat(F.lit(ITEM_URL_PREFIX), F.coalesce("objectID", F.lit("None")))).alias("url"),
    )
    cols = ["id", "text", "source", "platform", "created_at", "score", "url", "ord"]
    return p.select(*cols, *(["content_type"] if keep_type else []))


def topic_search_page(posts: DataFrame, topic: str, content_type: str, page: int,
                      hits_per_page: int = HITS_PER_PAGE) -> DataFrame:
    """Server-side search re-aimed as a table job (our ranking, documented).

    A post matches when every letter-term of ``topic`` occurs among its
    terms (case-insensitive); matches are ranked by the number of matching
    term occurrences, descending, then by arrival; page ``page`` holds ranks
    ``page*hits_per_page+1 .. (page+1)*hits_per_page``.  The window is
    partitioned by tag and the rank bound lets Spark keep only the top ranks
    per task before the shuffle.
    """
    q = [t for t in topic.lower().replace("_", " ").split() if t]
    qterms = F.array_distinct(F.flatten(F.array(*[terms(F.lit(t)) for t in q]))) if q else F.array()
    toks = terms("text")
    scored = (posts.where(F.col("content_type") == content_type)
              .withColumn("_toks", toks)
              .where(F.forall(qterms, lambda t: F.array_contains(F.col("_toks"), t)))
              .withColumn("matches", F.size(F.filter("_toks", lambda t: F.array_contains(qterms, t)))))
    w = Window.partitionBy("content_type").orderBy(F.col("matches").desc(), "ord")
    lo, hi = page * hits_per_page, (page + 1) * hits_per_page
    return (scored.withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") > lo) & (F.col("rank") <= hi))
            .drop("_toks"))
