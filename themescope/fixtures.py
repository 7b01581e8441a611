"""Derived views over the read-only test tables (see FIXTURES.md).

They turn ``documents``/``events``/``embeddings`` into the inputs the
reference exchanges (search hits, posts, vectors, clustered posts) with
deterministic column rules, without collecting anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.sources.hits import hits_to_posts
from themescope.operators.cluster import centroids_from_labels
from themescope.session import balance

# --- fixed values of the fixture definition --------------------------------
EVENT_STRIDE = 7919               # E(doc) = event (doc_id * 7919) % #events
TYPE_RANK = {"story": 0, "comment": 1}
HITS_PER_PAGE = 50
COMMENT_SUFFIX = " &amp;amp; &lt;i&gt;"
EXAMPLE_URL = "https://example.org/"
GAP_PAGE = 3
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               balanced: bool = False) -> DataFrame:
    """A test table pruned to ``columns``; ``balanced`` spreads a narrow scan
    over the cores before CPU-heavy text work (see ``session.balance``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return balance(df) if balanced else df


def documents_with_event(spark: SparkSession, sf_dir: str,
                         doc_cols=("doc_id", "text")) -> DataFrame:
    """documents ⋈ E(doc): each document gets one event's time and value.

    The event count is a scalar subquery, not a join; the lookup itself is an
    equi-join on the computed key, so both sides shuffle by key at scale.
    """
    docs = read_table(spark, sf_dir, "documents", list(doc_cols), balanced=True)
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    n_events = ev.select(F.count(F.lit(1))).scalar()
    keyed = docs.withColumn("event_id", (F.col("doc_id") * EVENT_STRIDE) % n_events)
    return keyed.join(ev, "event_id").drop("event_id")


def as_html(c):
    """``<p>`` + text with newlines as ``<br>`` (how the service returns bodies)."""
    return F.concat(F.lit("<p>"), F.replace(c, F.lit("\n"), F.lit("<br>")))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened search hits, one per document (schema ``schemas.HITS`` + ord)."""
    d = documents_with_event(spark, sf_dir)
    doc = F.col("doc_id")
    story = doc % 2 == 0
    half = F.floor(doc / 2).cast("long")
    page = F.floor(half / HITS_PER_PAGE).cast("int")
    pos = (half % HITS_PER_PAGE).cast("int")
    own_id = doc.cast("string")
    rest = F.expr("substr(text, 61)")
    return d.select(
        F.when(story, "story").otherwise("comment").alias("content_type"),
        page.alias("page"),
        pos.alias("pos"),
        F.when(doc % 11 == 10, (doc - 1).cast("string")).otherwise(own_id).alias("objectID"),
        # A story's title and story_text together always carry the whole document:
        # no title → all of it in story_text; no story_text → all of it in the title.
        F.when(story & (doc % 9 != 0),
               F.when(doc % 4 == 0, F.substring("text", 1, 60)).otherwise(F.col("text"))).alias("title"),
        F.when(story & (doc % 9 == 0), as_html(F.col("text")))
         .when(story & (doc % 4 == 0), as_html(rest)).alias("story_text"),
        F.when(~story, F.concat(as_html(F.col("text")), F.lit(COMMENT_SUFFIX))).alias("comment_text"),
        F.when(doc % 13 != 0, F.unix_timestamp("ts")).alias("created_at_i"),
        F.when(doc % 7 != 0, F.floor("value").cast("long")).alias("points"),
        F.when(doc % 5 == 0, F.lit("")).when(doc % 5 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(EXAMPLE_URL), own_id)).alias("url"),
        (F.when(story, 0).otherwise(1).cast("long") * 1_000_000_000_000
         + page.cast("long") * 1_000_000 + pos.cast("long")).alias("ord"),
    )


def hits_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where(F.col("page") != GAP_PAGE)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits through the projections, cleaning and the length filter."""
    return hits_to_posts(hits(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label",
                    F.col("vec_id").alias("ord"))


def clustered(spark: SparkSession, sf_dir: str, with_embedding: bool = False) -> DataFrame:
    """Every document with the vector and label of row doc_id % (number of vectors)."""
    d = documents_with_event(spark, sf_dir, ("doc_id", "text", "source", "lang"))
    e = read_table(spark, sf_dir, "embeddings")
    n_vectors = e.select(F.count(F.lit(1))).scalar()
    e = e.select("vec_id", F.col("label").alias("cluster"), *(["embedding"] if with_embedding else []))
    j = d.withColumn("vec_id", F.col("doc_id") % n_vectors).join(e, "vec_id")
    cols = [
        F.col("doc_id").cast("string").alias("id"), "text", "source", "lang",
        F.col("ts").cast("timestamp").alias("created_at"),
        F.floor("value").cast("long").alias("score"),
        F.col("doc_id").alias("ord"), "cluster",
    ]
    if with_embedding:
        cols.append("embedding")
    return j.select(*cols)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-label mean embedding, as DOUBLE arrays: (cluster, center)."""
    v = vectors(spark, sf_dir)
    return centroids_from_labels(v, "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the next one by id: (i, i+1) for i = 0..n-2.

    An equi-join on the computed key, so it stays a keyed shuffle at scale.
    """
    e = read_table(spark, sf_dir, "embeddings").select("vec_id")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("j"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").cast("string").alias("id_a"),
                                        F.col("j").cast("string").alias("id_b"))


def cluster_labels(clustered_df: DataFrame) -> DataFrame:
    """(cluster, 'Theme <cluster>') for every cluster present."""
    return (clustered_df.select("cluster").distinct()
            .select("cluster", F.concat(F.lit("Theme "), F.col("cluster").cast("string")).alias("label")))
