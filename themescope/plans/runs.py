"""End-to-end runs a user calls: the scrape phase over landed
pages and the theme-map run (gate → vectors → K-Means → quality → layout →
labels → report).

Reused intermediates (vectors, clustered posts) are written as Parquet under
the shared ``spark.checkpoint.dir`` and read back: later stages start from a
durable table, so a lost executor recomputes at most one stage and lineage
stays short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope import schemas
from themescope.functions.text import dataset_key
from themescope.operators import cluster as cl
from themescope.operators import encode as en
from themescope.operators import ingest as ing
from themescope.operators import kmeans as km
from themescope.operators import layout as lo
from themescope.operators import neighbours as nn
from themescope.operators import report as rp
from themescope.session import scratch_path
from themescope.sources import files as fs
from themescope.sources import hits as hs

# --- fixed values (run defaults) -------------------------------------------
DEFAULT_MAX_RESULTS = 200      # posts per scrape
MIN_POSTS = 20                 # a run stops below this many posts
NEIGHBOURS = 15
DEFAULT_K = 5
N_INIT = 10
SEED = 42
# ---------------------------------------------------------------------------


def scrape_phase(hits: DataFrame, max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """Landed hits → the posts a paged scrape would keep: pages up to the
    first empty one, cleaned and length-filtered, ``max_results // 2`` per
    type, then keep-first dedup by id."""
    reached = ing.pages_before_stop(hits)
    return ing.dedup_first(ing.type_quota(hs.hits_to_posts(reached), max_results))


def scrape_landed_pages(spark: SparkSession, path: str,
                        max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    return scrape_phase(hs.flatten_pages(hs.read_response_pages(spark, path)), max_results)


def gate(posts: DataFrame, min_posts: int = MIN_POSTS) -> None:
    """Stop a run with too few posts (reads at most ``min_posts`` rows)."""
    if posts.limit(min_posts).count() < min_posts:
        raise ValueError(f"fewer than {min_posts} posts; try a broader topic")


def _durable(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass
class ThemeMap:
    """Every table behind the dashboard page and the saved files."""
    clustered: DataFrame       # posts + cluster
    vectors: DataFrame         # id, embedding
    training_cost: float
    silhouette: DataFrame      # one row
    layout: DataFrame          # id, x, y
    labels: DataFrame          # cluster, label
    summary: DataFrame         # per cluster: label, size, share, sample, line
    shares: DataFrame          # pie data
    scatter: DataFrame         # layout ⋈ labels ⋈ hover text
    quotes: DataFrame          # five quote cards per cluster
    prompt: DataFrame          # report prompt (one row)
    report: DataFrame          # report text (one row)
    report_lines: DataFrame    # saved report file lines


def theme_map(posts: DataFrame, topic: str, k: int = DEFAULT_K,
              vectors: DataFrame | None = None,
              encoder: Callable[[], Callable] | None = None,
              labeler: Callable[[], Callable[[str], str]] | None = None,
              reporter: Callable[[], Callable[[str], str]] | None = None,
              exact_silhouette: bool = True, n_init: int = N_INIT, seed: int = SEED,
              min_posts: int = MIN_POSTS) -> ThemeMap:
    """The dashboard run over a posts table (id, text, score, ord, …) with
    unique ids — the output of ``scrape_phase`` or ``dedup_first``."""
    rp.require_topic(topic)
    gate(posts, min_posts)
    if vectors is None:
        vectors = en.encode(posts, encoder) if encoder else en.hashing_encoder(posts)
    vectors = _durable(vectors.select("id", "embedding"), "vectors")

    model, cost = km.kmeans_fit(vectors, k, n_init=n_init, seed=seed)
    assigned = km.kmeans_labels(vectors, model).select("id", "cluster")
    clustered = _durable(posts.join(assigned, "id"), "clustered")
    with_vec = clustered.join(vectors, "id")

    silhouette = (cl.silhouette_exact(with_vec) if exact_silhouette
                  else cl.silhouette_squared(with_vec))
    edges = nn.fuzzy_edges(nn.knn_graph(vectors, NEIGHBOURS), NEIGHBOURS)
    layout = _durable(lo.layout_epochs(edges, nn.project_2d(vectors)), "layout")

    if labeler is not None:
        prompts = rp.label_prompts(rp.cluster_samples(clustered))
        labels = en.apply_labeler(prompts, labeler).select("cluster", "label")
    else:
        labels = rp.keyword_labels(clustered).select("cluster", F.col("keywords").alias("label"))

    summary = rp.cluster_summary(clustered, labels)
    prompt = rp.report_prompt(summary, topic)
    if reporter is not None:
        report = en.apply_labeler(prompt, reporter, "prompt", "report").select("report")
    else:
        report = rp.template_report(summary)
    scatter = (layout.join(rp.hover_preview(clustered, labels), "id")
               .select("id", "x", "y", "cluster", "label", "text_150", "score"))
    return ThemeMap(
        clustered=clustered, vectors=vectors, training_cost=cost, silhouette=silhouette,
        layout=layout, labels=labels, summary=summary,
        shares=rp.cluster_share(clustered).join(labels, "cluster", "left"),
        scatter=scatter, quotes=rp.quote_cards(clustered, labels), prompt=prompt, report=report,
        report_lines=rp.report_lines(labels, report, topic))


# --- phase-by-phase flow: files are the interface ------------

def embed_phase(spark: SparkSession, posts_path: str, vectors_path: str,
                encoder: Callable[[], Callable] | None = None, topic: str | None = None) -> DataFrame:
    """posts CSV → vectors table (id, embedding), partitioned by dataset when a
    topic is given.  Returns the vector shape report."""
    posts = fs.read_posts_csv(spark, posts_path)
    vecs = en.encode(posts, encoder) if encoder else en.hashing_encoder(posts)
    if topic is None:
        vecs.write.mode("overwrite").parquet(vectors_path)
        stored = fs.read_vectors(spark, vectors_path)
    else:
        fs.write_table(vecs, vectors_path, topic=topic, mode="overwrite")
        stored = spark.read.parquet(vectors_path).where(F.col("dataset") == dataset_key(F.lit(topic)))
    return rp.vector_shape(stored)


def cluster_phase(spark: SparkSession, posts_path: str, vectors_path: str, k: int,
                  clustered_path: str, max_k: int = 10, n_init: int = N_INIT, seed: int = SEED):
    """posts CSV + vectors → elbow curve, cluster profile, clustered CSV.
    Returns (elbow rows, profile DataFrame).  Arrival order is that of the
    posts CSV (files by name, then rows) and kept as column ``ord`` of the output."""
    posts = fs.in_order(fs.read_posts_csv(spark, posts_path))
    vecs = spark.read.parquet(vectors_path).select("id", "embedding")
    curve = km.elbow_curve(vecs, max_k=max_k, n_init=n_init, seed=seed)
    model, _ = km.kmeans_fit(vecs, k, n_init=n_init, seed=seed)
    clustered = posts.join(km.kmeans_labels(vecs, model).select("id", "cluster"), "id")
    fs.write_csv(clustered.select(*schemas.CLUSTERED.names), clustered_path)
    return curve, rp.cluster_profile(fs.read_posts_csv(spark, clustered_path, with_cluster=True), k)


def report_phase(spark: SparkSession, clustered_folder: str, topic: str, report_path: str,
                 labeler: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """The topic's ``*_clustered.csv`` in a folder → labels → report file lines.
    Other datasets of the folder take no part."""
    rp.require_topic(topic)
    clustered = fs.read_clustered(spark, clustered_folder).where(F.col("dataset") == dataset_key(F.lit(topic)))
    if labeler is not None:
        labels = en.apply_labeler(rp.label_prompts(rp.cluster_samples(clustered)), labeler) \
            .select("cluster", "label")
    else:
        labels = rp.keyword_labels(clustered).select("cluster", F.col("keywords").alias("label"))
    summary = rp.cluster_summary(clustered, labels)
    lines = rp.report_lines(labels, rp.template_report(summary), topic)
    fs.write_report(lines, report_path)
    return lines
