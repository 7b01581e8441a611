"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir), reads the given tables (or views Spark
derives from them) in full and returns a DataFrame.  Doubles are rounded to
6 places in both the Spark result and the SQL so the value hashes compare.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope import fixtures as fx
from themescope import streaming as st
from themescope.functions import text as tx
from themescope.functions import vector as vx
from themescope.operators import cluster as cl
from themescope.operators import drift as dr
from themescope.operators import encode as en
from themescope.operators import ingest as ing
from themescope.operators import kmeans as km
from themescope.operators import layout as lo
from themescope.operators import neighbours as nn
from themescope.operators import report as rp
from themescope.operators import sparse as sp
from themescope.plans.oracle import clean, dotp, l2n, norm, sql, sqdist
from themescope.plans.oracle import terms as sql_terms
from themescope.session import configure, scratch_path, stored
from themescope.sources import files as fs
from themescope.sources import hits as hs

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

TOPIC = "opinion themes / drift in public discussion"   # report topic (> 30 chars, has '/')
QUOTA_CLI = 200        # posts per CLI run
QUOTA_APP_MAX = 300    # largest dashboard run
GATE_MIN_POSTS = 20
DENSE_K = 12           # ids 0..11 over 10 fixture clusters: two empty ones


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        REGISTRY[name] = (run, oracle)
        return run
    return deco


# ---------------------------------------------------------------- ingest ---

@register("hits_flatten", sql("""
    SELECT content_type, page, pos, objectID, title, story_text, comment_text,
           created_at_i, points, url, ord FROM hits""", "hits"))
def q_hits_flatten(spark, sf):
    """Hits re-nested as JSON response pages, parsed with the explicit schema
    and exploded again (SRC-1 on landed pages)."""
    pages = hs.parse_pages(hs.pages_as_json(fx.hits(spark, sf)))
    return hs.flatten_pages(pages)


@register("hits_to_posts", sql("SELECT * FROM posts", "posts"))
def q_hits_to_posts(spark, sf):
    return fx.posts(spark, sf)


@register("clean_pages", f"SELECT page_id, {clean('html')} AS text FROM pages")
def q_clean_pages(spark, sf):
    return fx.read_table(spark, sf, "pages", ["page_id", "html"], balanced=True).select("page_id", tx.clean_text("html").alias("text"))


@register("min_length", sql("""
    SELECT content_type, count(*) AS n_hits,
           count(*) FILTER (WHERE length(text) >= 40) AS n_kept,
           count(*) FILTER (WHERE length(text) < 40) AS n_short
    FROM posts_all GROUP BY content_type""", "posts_all"))
def q_min_length(spark, sf):
    return ing.length_counts(hs.hits_to_posts(fx.hits(spark, sf), min_chars=0))


@register("type_quota", sql(f"""
    SELECT * FROM posts
    QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY ord) <= {QUOTA_CLI // 2}""", "posts"))
def q_type_quota(spark, sf):
    return ing.type_quota(fx.posts(spark, sf), QUOTA_CLI)


@register("dedup_first", sql("""
    SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""", "posts"))
def q_dedup_first(spark, sf):
    return ing.dedup_first(fx.posts(spark, sf))


@register("page_scan_stop", sql(f"""
    SELECT id, text, source, platform, created_at, score, url, ord, content_type FROM (
      SELECT * FROM (
        SELECT p.* FROM posts_g p JOIN stops s USING (content_type) WHERE p.page < s.stop_page)
      QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY ord) <= {QUOTA_APP_MAX // 2})
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""", "hits_gap", "posts_all", extra=[
    ("posts_g", """
        SELECT pa.* FROM posts_all pa SEMI JOIN hits_gap g USING (ord) WHERE length(pa.text) >= 40"""),
    ("pg", "SELECT DISTINCT content_type, page FROM hits_gap"),
    ("stops", """
        SELECT content_type, min(c.page) AS stop_page FROM (
          SELECT content_type, page + 1 AS page FROM pg UNION SELECT content_type, 0 FROM pg) c
        WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.content_type = c.content_type AND pg.page = c.page)
        GROUP BY content_type""")]))
def q_page_scan_stop(spark, sf):
    h = ing.pages_before_stop(fx.hits_gap(spark, sf))
    return ing.dedup_first(ing.type_quota(hs.hits_to_posts(h), QUOTA_APP_MAX))


SEARCH_TOPIC, SEARCH_TAG, SEARCH_PAGE = "The and", "comment", 1


@register("topic_search_page", sql(f"""
    SELECT id, content_type, rank, matches, ord FROM (
      SELECT id, content_type, ord, matches,
             CAST(row_number() OVER (PARTITION BY content_type ORDER BY matches DESC, ord) AS INTEGER) AS rank
      FROM (SELECT id, content_type, ord,
                   CAST(len(list_filter(toks, lambda t: list_contains(['the', 'and'], t))) AS INTEGER) AS matches
            FROM (SELECT *, {sql_terms('text')} AS toks FROM posts WHERE content_type = '{SEARCH_TAG}')
            WHERE list_contains(toks, 'the') AND list_contains(toks, 'and')))
    WHERE rank > {SEARCH_PAGE * 50} AND rank <= {(SEARCH_PAGE + 1) * 50}""", "posts"))
def q_topic_search_page(spark, sf):
    return hs.topic_search_page(fx.posts(spark, sf), SEARCH_TOPIC, SEARCH_TAG, SEARCH_PAGE).select(
        "id", "content_type", "rank", "matches", "ord")


@register("dataset_key", """
    SELECT doc_id, replace(replace(substring(text, 1, 30), ' ', '_'), '/', '-') AS dataset FROM documents""")
def q_dataset_key(spark, sf):
    """Every document's whole text taken as a topic → its dataset key."""
    d = fx.read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", tx.dataset_key("text").alias("dataset"))


@register("preview", sql("""
    SELECT source, score, created_at, text FROM dedup ORDER BY ord LIMIT 10""", "posts",
    extra=[("dedup", "SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")]))
def q_preview(spark, sf):
    return rp.preview_rows(ing.dedup_first(fx.posts(spark, sf)))


@register("date_range", sql("""
    SELECT count(*) AS n_posts, strftime(min(created_at), '%Y-%m') AS first_month,
           strftime(max(created_at), '%Y-%m') AS last_month FROM dedup""", "posts",
    extra=[("dedup", "SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")]))
def q_date_range(spark, sf):
    return rp.date_range(ing.dedup_first(fx.posts(spark, sf)))


@register("multi_source_union", sql(f"""
    SELECT CAST(doc_id AS VARCHAR) AS id, {clean('text')} AS text, source, 'documents' AS platform,
           CAST(doc_id AS BIGINT) AS ord FROM documents
    UNION ALL
    SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), {clean('text')}, role, 'conversations',
           2000000000000 + conv_id * 1000 + turn FROM conversations"""))
def q_multi_source_union(spark, sf):
    docs = fx.read_table(spark, sf, "documents", ["doc_id", "text", "source"], balanced=True).select(
        F.col("doc_id").cast("string").alias("id"), "text", "source",
        F.lit("documents").alias("platform"), F.col("doc_id").cast("long").alias("ord"))
    conv = fx.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"], balanced=True).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "text", F.col("role").alias("source"), F.lit("conversations").alias("platform"),
        (F.lit(2_000_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return fs.union_sources([docs, conv]).withColumn("text", tx.clean_text("text"))


@register("dataset_gate", sql(f"""
    SELECT c.id, c.source AS dataset FROM clustered c
    SEMI JOIN (SELECT source FROM clustered GROUP BY source HAVING count(*) >= {GATE_MIN_POSTS}) g
      ON g.source = c.source""", "clustered"))
def q_dataset_gate(spark, sf):
    c = fx.clustered(spark, sf).withColumnRenamed("source", "dataset")
    return ing.dataset_gate(c, GATE_MIN_POSTS).select("id", "dataset")


# ------------------------------------------------------- cluster reports ---

@register("cluster_sizes", sql("SELECT cluster, count(*) AS n_posts FROM clustered GROUP BY cluster",
                               "clustered"))
def q_cluster_sizes(spark, sf):
    return rp.cluster_sizes(fx.clustered(spark, sf))


@register("cluster_sizes_dense", sql(f"""
    SELECT CAST(r.range AS INTEGER) AS cluster, coalesce(s.n, 0) AS n_posts
    FROM range({DENSE_K}) r LEFT JOIN (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster) s
      ON s.cluster = r.range""", "clustered"))
def q_cluster_sizes_dense(spark, sf):
    return rp.cluster_sizes_dense(fx.clustered(spark, sf), DENSE_K)


@register("cluster_share", sql("""
    SELECT cluster, count(*) AS n_posts,
           round_even(count(*) / (SELECT count(*) FROM clustered) * 100, 1) AS pct
    FROM clustered GROUP BY cluster""", "clustered"))
def q_cluster_share(spark, sf):
    return rp.cluster_share(fx.clustered(spark, sf))


@register("corpus_stats", sql("""
    SELECT count(*) AS n_posts, count(DISTINCT cluster) AS n_clusters FROM clustered""", "clustered"))
def q_corpus_stats(spark, sf):
    return rp.corpus_stats(fx.clustered(spark, sf))


_FIRST8 = ("first8", """SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS rank
                        FROM clustered WHERE text IS NOT NULL QUALIFY rank <= 8""")
_SAMPLES = ("samples", """SELECT cluster, string_agg(CAST(rank AS VARCHAR) || '. ' || substring(text, 1, 200),
                                                     chr(10) ORDER BY rank) AS samples
                          FROM first8 GROUP BY cluster""")


@register("cluster_samples", sql("SELECT * FROM samples", "clustered", extra=[_FIRST8, _SAMPLES]))
def q_cluster_samples(spark, sf):
    return rp.cluster_samples(fx.clustered(spark, sf))


@register("label_prompts", sql(
    "SELECT cluster, "
    "'You are analyzing online discussion posts grouped by semantic similarity.' || chr(10) || chr(10) || "
    "'Here are posts from one group:' || chr(10) || samples || chr(10) || chr(10) || "
    "'Give this group a short, specific label (4-7 words) that captures the dominant opinion or narrative.' "
    "|| chr(10) || 'Reply with ONLY the label. No explanation, no punctuation at the end.' AS prompt "
    "FROM samples", "clustered", extra=[_FIRST8, _SAMPLES]))
def q_label_prompts(spark, sf):
    return rp.label_prompts(rp.cluster_samples(fx.clustered(spark, sf)))


@register("cluster_profile", sql(f"""
    SELECT CAST(r.range AS INTEGER) AS cluster, coalesce(s.n, 0) AS n_posts,
           'CLUSTER ' || CAST(r.range AS VARCHAR) || ' (' || CAST(coalesce(s.n, 0) AS VARCHAR) || ' posts)' AS header,
           coalesce(t.samples, '') AS samples
    FROM range({DENSE_K}) r
    LEFT JOIN (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster) s ON s.cluster = r.range
    LEFT JOIN (SELECT cluster, string_agg('  • ' || substring(text, 1, 200), chr(10) ORDER BY rank) AS samples
               FROM (SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS rank
                     FROM clustered QUALIFY rank <= 3) GROUP BY cluster) t ON t.cluster = r.range""",
    "clustered"))
def q_cluster_profile(spark, sf):
    return rp.cluster_profile(fx.clustered(spark, sf), DENSE_K)


@register("label_lookup", sql("""
    SELECT c.id, c.cluster, l.label FROM clustered c LEFT JOIN labels l USING (cluster)""", "labels"))
def q_label_lookup(spark, sf):
    c = fx.clustered(spark, sf)
    return rp.label_lookup(c, fx.cluster_labels(c)).select("id", "cluster", "label")


@register("hover_preview", sql("""
    SELECT c.id, c.cluster, 'Cluster ' || CAST(c.cluster AS VARCHAR) AS cluster_name, l.label,
           substring(c.text, 1, 120) || '...' AS text_120, substring(c.text, 1, 150) || '...' AS text_150,
           c.score
    FROM clustered c LEFT JOIN labels l USING (cluster)""", "labels"))
def q_hover_preview(spark, sf):
    c = fx.clustered(spark, sf)
    return rp.hover_preview(c, fx.cluster_labels(c))


@register("quote_cards", sql("""
    SELECT f.cluster, f.rank, 'CLUSTER ' || CAST(f.cluster AS VARCHAR) || ' // ' || l.label AS heading,
           substring(replace(replace(replace(f.text, '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), 1, 350)
             || '...' AS quote
    FROM (SELECT cluster, text, CAST(row_number() OVER (PARTITION BY cluster ORDER BY ord) AS INTEGER) AS rank
          FROM clustered WHERE text IS NOT NULL QUALIFY rank <= 5) f
    LEFT JOIN labels l USING (cluster)""", "labels"))
def q_quote_cards(spark, sf):
    c = fx.clustered(spark, sf)
    return rp.quote_cards(c, fx.cluster_labels(c))


_SUMMARY = ("summary", """
    SELECT l.cluster, l.label, coalesce(p.n, 0) AS n_posts,
           round_even(coalesce(p.n, 0) / (SELECT count(*) FROM clustered) * 100, 1) AS pct,
           substring(p.first_text, 1, 150) AS sample,
           chr(10) || 'Cluster "' || l.label || '" ('
             || CAST(round_even(coalesce(p.n, 0) / (SELECT count(*) FROM clustered) * 100, 1) AS VARCHAR)
             || '% of posts):' || chr(10) || '  e.g. "' || substring(p.first_text, 1, 150) || '"' || chr(10) AS line
    FROM labels l LEFT JOIN (
      SELECT cluster, count(*) AS n, arg_min(text, ord) FILTER (WHERE text IS NOT NULL) AS first_text
      FROM clustered GROUP BY cluster) p USING (cluster)""")


@register("cluster_summary", sql("SELECT * FROM summary", "labels", extra=[_SUMMARY]))
def q_cluster_summary(spark, sf):
    c = fx.clustered(spark, sf)
    return rp.cluster_summary(c, fx.cluster_labels(c))


@register("report_prompt", sql(
    "SELECT CAST(sum(n_posts) AS BIGINT) AS total, string_agg(line, '' ORDER BY cluster) AS summary, "
    "'You are an analyst summarizing public opinion from Hacker News discussions.' || chr(10) || chr(10) "
    f"|| 'Topic: \"{TOPIC}\"' || chr(10) || 'Total posts analyzed: ' || CAST(sum(n_posts) AS VARCHAR) "
    "|| chr(10) || chr(10) || 'Opinion clusters discovered:' || chr(10) || string_agg(line, '' ORDER BY cluster) "
    "|| chr(10) || chr(10) || 'Write a 150-200 word plain-English \"State of Discourse\" report that:' || chr(10) "
    "|| '- Describes the dominant narratives people hold about this topic' || chr(10) "
    "|| '- Notes which viewpoints are most and least common' || chr(10) "
    "|| '- Highlights tensions or contradictions between clusters' || chr(10) "
    "|| '- Ends with one sentence on where the conversation is heading' || chr(10) || chr(10) "
    "|| 'Flowing paragraphs only, no bullet points.' AS prompt FROM summary",
    "labels", extra=[_SUMMARY]))
def q_report_prompt(spark, sf):
    c = fx.clustered(spark, sf)
    return rp.report_prompt(rp.cluster_summary(c, fx.cluster_labels(c)), TOPIC)


@register("report_lines", sql(f"""
    SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
    SELECT * FROM (VALUES (0, 'OPINION DRIFT REPORT: ' || upper('{TOPIC}')), (1, repeat('=', 60)), (2, ''),
                          (3, 'CLUSTER LABELS'), (4, repeat('-', 30)),
                          (999996, ''), (999997, ''), (999998, 'STATE OF DISCOURSE'), (999999, repeat('-', 30))) v(line_no, line)
    UNION ALL SELECT 5 + cluster, '  Cluster ' || CAST(cluster AS VARCHAR) || ': ' || label FROM labels
    UNION ALL SELECT 1000000 + generate_subscripts(parts, 1) - 1, unnest(parts) FROM (
      SELECT string_split('Across ' || CAST(total AS VARCHAR) || ' posts in ' || CAST(k AS VARCHAR)
        || ' themes, the most common view is "' || top.label || '" (' || CAST(top.pct AS VARCHAR) || '% of posts), e.g. "'
        || top.sample || '". The least common is "' || low.label || '" (' || CAST(low.pct AS VARCHAR)
        || '% of posts), e.g. "' || low.sample || '".', chr(10)) AS parts
      FROM (SELECT arg_max(s, (n_posts, -cluster)) AS top, arg_min(s, (n_posts, cluster)) AS low,
                   sum(n_posts) AS total, count(*) AS k
            FROM (SELECT *, {{'label': label, 'pct': pct, 'sample': sample}} AS s FROM summary))))""",
    "labels", extra=[_SUMMARY]))
def q_report_lines(spark, sf):
    c = fx.clustered(spark, sf)
    labels = fx.cluster_labels(c)
    summary = rp.cluster_summary(c, labels)
    return rp.report_lines(labels, rp.template_report(summary), TOPIC)


@register("keyword_labels", sql("""
    SELECT cluster, string_agg(term, ', ' ORDER BY score DESC, term) AS keywords FROM (
      SELECT cluster, term, round(tf * ln(1 + (SELECT sum(tf) / count(DISTINCT cluster) FROM tf) / f), 6) AS score
      FROM tf JOIN (SELECT term, sum(tf) AS f FROM tf GROUP BY term) USING (term)
      QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) <= 5)
    GROUP BY cluster""", "clustered", extra=[
    ("toks", f"SELECT cluster, unnest({sql_terms('text', 4)}) AS term FROM clustered"),
    ("tf", "SELECT cluster, term, count(*) AS tf FROM toks GROUP BY cluster, term")]))
def q_keyword_labels(spark, sf):
    return rp.keyword_labels(fx.clustered(spark, sf))


# --------------------------------------------------------------- vectors ---

KNN_K = 15
KMEANS_K = 5
R6 = 6


def _r(c, places: int = R6):
    return F.round(c, places)


_NV = ("nv", f"SELECT id, label, {l2n('embedding')} AS v FROM vectors")
_COS = (f"CASE WHEN {norm('a.embedding')} > 0 AND {norm('b.embedding')} > 0 "
        f"THEN {dotp('a.embedding', 'b.embedding')} / ({norm('a.embedding')} * {norm('b.embedding')}) ELSE 0 END")
_SIMS = ("sims", f"""SELECT p.id_a, p.id_b, {_COS} AS sim FROM pairs p
                    JOIN vectors a ON a.id = p.id_a JOIN vectors b ON b.id = p.id_b""")


def _assign_sql(src: str, centres: str, name: str) -> tuple[str, str]:
    """Nearest centre for rows (id, v) of ``src``; ties → lowest cluster."""
    return (name, f"""SELECT id, cluster, d2 FROM (
        SELECT s.id, c.cluster, {sqdist('s.v', 'c.center')} AS d2 FROM {src} s, {centres} c)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, cluster) = 1""")


def _means_sql(src: str, assign: str, name: str) -> tuple[str, str]:
    return (name, f"""SELECT cluster, list(m ORDER BY pos) AS center FROM (
        SELECT a.cluster, u.pos, avg(u.x) AS m FROM (
          SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {src}) u
        JOIN {assign} a USING (id) GROUP BY a.cluster, u.pos) GROUP BY cluster""")


def _pairs_vectors(spark, sf):
    v = fx.vectors(spark, sf)
    p = fx.pairs(spark, sf)
    a = v.select(F.col("id").alias("id_a"), F.col("embedding").alias("ea"))
    b = v.select(F.col("id").alias("id_b"), F.col("embedding").alias("eb"))
    return p.join(a, "id_a").join(b, "id_b").withColumn("sim", vx.cosine("ea", "eb"))


@register("vectors_scan", f"""
    SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dim, round({norm('embedding')}, 6) AS norm, label
    FROM embeddings""")
def q_vectors_scan(spark, sf):
    v = fx.vectors(spark, sf)
    return v.select("id", F.size("embedding").alias("dim"), _r(vx.norm("embedding")).alias("norm"), "label")


@register("vector_shape", """
    SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS dim_min,
           CAST(max(len(embedding)) AS INTEGER) AS dim_max,
           CAST(sum(len(embedding)) * 4 AS BIGINT) AS n_bytes FROM embeddings""")
def q_vector_shape(spark, sf):
    return rp.vector_shape(fx.vectors(spark, sf))


@register("vector_normalize", sql(f"""
    SELECT id, round({norm('v')}, 6) AS norm_after, round(v[1], 6) AS first_value,
           round(list_sum(v), 6) AS value_sum FROM nv""", "vectors", extra=[_NV]))
def q_vector_normalize(spark, sf):
    v = fx.vectors(spark, sf).withColumn("v", vx.l2_normalize("embedding"))
    return v.select("id", _r(vx.norm("v")).alias("norm_after"), _r(F.col("v")[0]).alias("first_value"),
                    _r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("value_sum"))


@register("pair_similarity", sql("SELECT id_a, id_b, round(sim, 6) AS similarity FROM sims",
                                 "pairs", "vectors", extra=[_SIMS]))
def q_pair_similarity(spark, sf):
    return _pairs_vectors(spark, sf).select("id_a", "id_b", _r(F.col("sim")).alias("similarity"))


_ALL_SIMS = ("all_sims", f"""SELECT a.id AS id_a, b.id AS id_b, {_COS} AS sim
                              FROM vectors a JOIN vectors b ON a.ord < b.ord""")
_BAND_SQL = "CASE WHEN sim > 0.6 THEN 'very similar' WHEN sim > 0.3 THEN 'loosely related' ELSE 'unrelated' END"


@register("similarity_bands", sql(f"SELECT {_BAND_SQL} AS band, count(*) AS n_pairs FROM all_sims GROUP BY band",
                                  "vectors", extra=[_ALL_SIMS]))
def q_similarity_bands(spark, sf):
    """Band counts over every distinct pair of the vector table (exact, block × block)."""
    return nn.similarity_band_counts(fx.vectors(spark, sf))


@register("similar_pairs", sql(f"""SELECT id_a, id_b, round(sim, 6) AS similarity, {_BAND_SQL} AS band
                                   FROM all_sims WHERE sim > 0.3""", "vectors", extra=[_ALL_SIMS]))
def q_similar_pairs(spark, sf):
    """Every distinct pair at least loosely related (cosine > 0.3), with its band."""
    s = nn.similar_pairs(fx.vectors(spark, sf), tx.BAND_LOW)
    return s.select("id_a", "id_b", _r(F.col("sim")).alias("similarity"), tx.similarity_band(F.col("sim")).alias("band"))


def _assigned(spark, sf):
    v = fx.vectors(spark, sf)
    return cl.assign_nearest(v, cl.centres_literal(fx.centroids(spark, sf)))


@register("assign_nearest", sql("SELECT id, cluster, round(d2, 6) AS sq_dist FROM a0",
                                "vectors", "centroids", extra=[_NV, _assign_sql("nv", "centroids", "a0")]))
def q_assign_nearest(spark, sf):
    return _assigned(spark, sf).select("id", "cluster", _r(F.col("sq_dist")).alias("sq_dist"))


@register("assignment_inertia", sql("SELECT round(sum(d2), 6) AS inertia, count(*) AS n FROM a0",
                                    "vectors", "centroids", extra=[_NV, _assign_sql("nv", "centroids", "a0")]))
def q_assignment_inertia(spark, sf):
    return cl.inertia(_assigned(spark, sf)).select(_r(F.col("inertia")).alias("inertia"), "n")


def _explode_centres(c: DataFrame) -> DataFrame:
    return c.select("cluster", F.posexplode("center").alias("pos", "value")).select(
        "cluster", "pos", _r(F.col("value")).alias("value"))


_EXPLODE_SQL = """SELECT cluster, pos, round(value, 6) AS value FROM (
    SELECT cluster, unnest(center) AS value, CAST(generate_subscripts(center, 1) - 1 AS INTEGER) AS pos
    FROM {src})"""


@register("centroid_update", sql(_EXPLODE_SQL.format(src="c1"), "vectors", "centroids", extra=[
    _NV, _assign_sql("nv", "centroids", "a0"), _means_sql("nv", "a0", "c1")]))
def q_centroid_update(spark, sf):
    v = fx.vectors(spark, sf)
    return _explode_centres(cl.lloyd_step(v, cl.centres_literal(fx.centroids(spark, sf))))


@register("lloyd_two_steps", sql(_EXPLODE_SQL.format(src="c2"), "vectors", "centroids", extra=[
    _NV, _assign_sql("nv", "centroids", "a0"), _means_sql("nv", "a0", "c1"),
    _assign_sql("nv", "c1", "a1"), _means_sql("nv", "a1", "c2")]))
def q_lloyd_two_steps(spark, sf):
    v = fx.vectors(spark, sf)
    c1 = cl.lloyd_steps(v, fx.centroids(spark, sf), 1)
    return _explode_centres(cl.lloyd_step(v, cl.centres_literal(c1)))


_SIL_SQL = sql(f"""
    SELECT round(avg(CASE WHEN n_own IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0
                          ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n
    FROM (SELECT id, cluster, max(CASE WHEN other = cluster THEN s / c END) AS a,
                 min(CASE WHEN other <> cluster THEN s / c END) AS b,
                 max(CASE WHEN other = cluster THEN c END) AS n_own
          FROM (SELECT x.id, x.label AS cluster, y.label AS other, sum(sqrt({sqdist('x.v', 'y.v')})) AS s,
                       count(*) AS c
                FROM nv x JOIN nv y ON x.id <> y.id GROUP BY ALL) GROUP BY id, cluster)""",
    "vectors", extra=[_NV])


@register("silhouette_exact", _SIL_SQL)
def q_silhouette_exact(spark, sf):
    r = cl.silhouette_exact(fx.vectors(spark, sf), cluster_col="label")
    return r.select(_r(F.col("silhouette")).alias("silhouette"), "n")


@register("silhouette_squared", sql(f"""
    SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM (
      SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1
                  ELSE 0 END AS s
      FROM (SELECT p.id, max(CASE WHEN st.cluster = p.label THEN d * st.n / (st.n - 1) END) AS a,
                   max(CASE WHEN st.cluster = p.label THEN st.n END) AS n_own,
                   min(CASE WHEN st.cluster <> p.label THEN d END) AS b
            FROM (SELECT p.id, p.label, st.cluster, st.n,
                         list_sum(list_transform(p.v, lambda x: x * x)) + st.psi / st.n
                           - 2 * {dotp('p.v', 'st.s')} / st.n AS d
                  FROM nv p, st) p JOIN st ON st.cluster = p.cluster GROUP BY p.id))""",
    "vectors", extra=[_NV,
    ("st", """SELECT s.cluster, s.s, n.n, n.psi FROM (
        SELECT cluster, list(m ORDER BY pos) AS s FROM (
          SELECT label AS cluster, pos, sum(x) AS m FROM (
            SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM nv) GROUP BY label, pos)
        GROUP BY cluster) s
      JOIN (SELECT label AS cluster, count(*) AS n, sum(list_sum(list_transform(v, lambda x: x * x))) AS psi
            FROM nv GROUP BY label) n USING (cluster)""")]))
def q_silhouette_squared(spark, sf):
    r = cl.silhouette_squared(fx.vectors(spark, sf), cluster_col="label")
    return r.select(_r(F.col("silhouette")).alias("silhouette"), "n")


@register("knn_graph", sql(f"""
    SELECT id, nbr, rank, round(d, 6) AS dist FROM (
      SELECT a.id, b.id AS nbr, sqrt({sqdist('a.embedding', 'b.embedding')}) AS d,
             CAST(row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) AS INTEGER) AS rank
      FROM vectors a JOIN vectors b ON a.id <> b.id QUALIFY rank <= {KNN_K})""", "vectors"))
def q_knn_graph(spark, sf):
    g = nn.knn_graph(fx.vectors(spark, sf), KNN_K)
    return g.select("id", "nbr", "rank", _r(F.col("dist")).alias("dist"))


_KNN_SQL = ("knn", f"""SELECT a.id, b.id AS nbr, sqrt({sqdist('a.embedding', 'b.embedding')}) AS d
    FROM vectors a JOIN vectors b ON a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= {KNN_K}""")
_MASS = "list_sum(list_transform(p.ds, lambda x: exp(-greatest(x - p.rho, 0.0) / ((b.lo + b.hi) / 2))))"


@register("fuzzy_edges", sql(f"""
    SELECT coalesce(a.src, r.dst) AS src, coalesce(a.dst, r.src) AS dst,
           round(coalesce(a.w, 0.0) + coalesce(r.w, 0.0) - coalesce(a.w, 0.0) * coalesce(r.w, 0.0), 6) AS weight
    FROM w a FULL OUTER JOIN w r ON a.src = r.dst AND a.dst = r.src""", "vectors", extra=[
    _KNN_SQL,
    ("per", "SELECT id, list(d ORDER BY d, nbr) AS ds, min(d) AS rho, max(d) AS dmax FROM knn GROUP BY id"),
    ("bis", f"""SELECT * FROM (WITH RECURSIVE b(id, it, lo, hi) AS (
        SELECT id, 0, CAST(0 AS DOUBLE), dmax * 1000 + 1000 FROM per
        UNION ALL
        SELECT b.id, b.it + 1,
               CASE WHEN {_MASS} > {math.log2(KNN_K)!r} THEN b.lo ELSE (b.lo + b.hi) / 2 END,
               CASE WHEN {_MASS} > {math.log2(KNN_K)!r} THEN (b.lo + b.hi) / 2 ELSE b.hi END
        FROM b JOIN per p USING (id) WHERE b.it < 64) SELECT * FROM b WHERE it = 64)"""),
    ("w", """SELECT k.id AS src, k.nbr AS dst, exp(-greatest(k.d - p.rho, 0.0) / ((s.lo + s.hi) / 2)) AS w
             FROM knn k JOIN per p USING (id) JOIN bis s USING (id)""")]))
def q_fuzzy_edges(spark, sf):
    g = nn.knn_graph(fx.vectors(spark, sf), KNN_K)
    return nn.fuzzy_edges(g, KNN_K).select("src", "dst", _r(F.col("weight")).alias("weight"))


@register("layout_2d", None)
def q_layout_2d(spark, sf):
    v = fx.vectors(spark, sf)
    edges = nn.fuzzy_edges(nn.knn_graph(v, KNN_K), KNN_K)
    return lo.layout_epochs(edges, nn.project_2d(v))


@register("project_2d", None)
def q_project_2d(spark, sf):
    return nn.project_2d(fx.vectors(spark, sf))


@register("kmeans_fit", None)
def q_kmeans_fit(spark, sf):
    v = fx.vectors(spark, sf)
    model, _ = km.kmeans_fit(v, KMEANS_K)
    return km.kmeans_labels(v, model).select("id", "cluster")


@register("elbow_curve", None)
def q_elbow_curve(spark, sf):
    curve = km.elbow_curve(fx.vectors(spark, sf), max_k=10)
    return spark.createDataFrame([(k, float(c)) for k, c in curve], "k INT, inertia DOUBLE")


HASH_DIM = 384
_TFIDF = [
    ("src", "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, coalesce(text, '') AS text FROM documents"),
    ("tf", f"""SELECT id, CAST(CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {HASH_DIM} AS INTEGER) AS bucket,
                     CAST(count(*) AS DOUBLE) AS tf
              FROM (SELECT id, unnest({sql_terms('text')}) AS term FROM src) GROUP BY ALL"""),
    ("idf", "SELECT bucket, ln(((SELECT count(*) FROM src) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY bucket"),
    ("nw", """SELECT id, bucket, CASE WHEN n > 0 THEN w / n ELSE 0 END AS weight FROM (
                SELECT id, bucket, w, sqrt(sum(w * w) OVER (PARTITION BY id)) AS n FROM (
                  SELECT id, bucket, tf * idf AS w FROM tf JOIN idf USING (bucket)))"""),
]


@register("encode_documents", sql("""
    SELECT id, CAST(count(*) AS BIGINT) AS n_buckets, CAST(count(*) FILTER (WHERE weight > 0) AS BIGINT) AS n_nonzero,
           round(sqrt(sum(weight * weight)), 6) AS norm, arg_max(bucket, (weight, -bucket)) AS top_bucket,
           round(max(weight), 6) AS top_weight
    FROM nw GROUP BY id""", extra=_TFIDF))
def q_encode_documents(spark, sf):
    """The default encoder's TF-IDF weights over every document, summarised per document."""
    d = fx.read_table(spark, sf, "documents", ["doc_id", "text"], balanced=True).select(
        F.col("doc_id").cast("string").alias("id"), "text")
    w = en.tfidf_weights(d, dim=HASH_DIM)
    return w.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_buckets"), F.count(F.when(F.col("weight") > 0, 1)).alias("n_nonzero"),
        _r(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("norm"),
        F.max_by("bucket", F.struct("weight", -F.col("bucket"))).alias("top_bucket"),
        _r(F.max("weight")).alias("top_weight"))


@register("near_duplicates", sql(f"""
    SELECT a.id AS id_a, b.id AS id_b, round({dotp('a.v', 'b.v')}, 6) AS similarity
    FROM dense a JOIN dense b ON a.ord < b.ord
    WHERE {dotp('a.v', 'b.v')} > 0.6""", extra=_TFIDF + [
    ("dense", f"""SELECT s.id, s.ord, list(coalesce(nw.weight, 0.0) ORDER BY g.bucket) AS v
                 FROM src s CROSS JOIN (SELECT range AS bucket FROM range({HASH_DIM})) g
                 LEFT JOIN nw ON nw.id = s.id AND nw.bucket = g.bucket GROUP BY s.id, s.ord""")]))
def q_near_duplicates(spark, sf):
    """Pairs of documents whose default-encoder vectors are very similar
    (cosine > 0.6): exact and near copies, over every pair of the whole table."""
    d = fx.read_table(spark, sf, "documents", ["doc_id", "text"], balanced=True).select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))
    v, idf = en.hashed_counts(d, dim=HASH_DIM)
    # Written once: sizes are read from it before the blocks are packed.
    v = stored(v.join(d.select("id", "ord"), "id"), "document-vectors")
    s = nn.similar_pairs(v, tx.BAND_HIGH, scale=idf)
    return s.select("id_a", "id_b", _r(F.col("sim")).alias("similarity"))


_SPARSE_T = 0.8


@register("near_duplicate_classes", sql(f"""
    SELECT s.id, c.class_id, n.copies - 1 + coalesce(o.other, 0) AS n_links, s.id = c.class_id AS kept
    FROM src s JOIN nodes n USING (node) JOIN classes c USING (node) LEFT JOIN others o USING (node)""", extra=[
    ("src", "SELECT doc_id AS id, md5(coalesce(text, '')) AS node, coalesce(text, '') AS text FROM documents"),
    ("nodes", "SELECT node, count(*) AS copies, min(id) AS least, any_value(text) AS text FROM src GROUP BY node"),
    ("tf", f"""SELECT node, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {sp.TERM_BUCKETS} AS bucket,
                     CAST(count(*) AS DOUBLE) AS tf
              FROM (SELECT node, unnest({sql_terms('text')}) AS term FROM nodes) GROUP BY ALL"""),
    ("w", """SELECT node, bucket, tf * ln(((SELECT count(*) FROM nodes) + 1.0) / (n + 1.0)) AS w
             FROM tf JOIN (SELECT bucket, count(*) AS n FROM tf GROUP BY bucket) USING (bucket)"""),
    ("nw", """SELECT node, bucket, w / n AS weight FROM (
                SELECT *, sqrt(sum(w * w) OVER (PARTITION BY node)) AS n FROM w) WHERE n > 0"""),
    ("pairs", f"""SELECT a.node AS a, b.node AS b FROM nw a JOIN nw b ON a.bucket = b.bucket AND a.node < b.node
                  GROUP BY ALL HAVING sum(a.weight * b.weight) >= {_SPARSE_T}"""),
    ("both_ways", "SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs"),
    ("others", "SELECT a AS node, CAST(sum(copies) AS BIGINT) AS other FROM both_ways JOIN nodes ON nodes.node = b GROUP BY a"),
    ("reached", """SELECT * FROM (WITH RECURSIVE r(node, other) AS (
        SELECT node, node FROM nodes UNION SELECT r.node, b.b FROM r JOIN both_ways b ON b.a = r.other) SELECT * FROM r)"""),
    ("classes", "SELECT r.node, min(n.least) AS class_id FROM reached r JOIN nodes n ON n.node = r.other GROUP BY r.node")]))
def q_near_duplicate_classes(spark, sf):
    """Classes of documents that link at a TF-IDF cosine of 0.8 over whole terms: one row
    per document, found by an inverted index instead of all block pairs."""
    return sp.near_duplicate_classes(fx.read_table(spark, sf, "documents", ["doc_id", "text"], balanced=True), _SPARSE_T)


@register("hashed_term_counts", f"""
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_buckets, arg_max(bucket, (n, -bucket)) AS top_bucket,
           max(n) AS top_count
    FROM (SELECT doc_id, CAST(CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 384 AS INTEGER) AS bucket,
                 count(*) AS n
          FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents) GROUP BY ALL)
    GROUP BY doc_id""")
def q_hashed_term_counts(spark, sf):
    return en.hashed_term_counts(fx.read_table(spark, sf, "documents", ["doc_id", "text"], balanced=True), HASH_DIM)


# ------------------------------------------------------------------ drift ---

_TL = ("tl", """SELECT period_start, cluster, n_posts, n_posts / sum(n_posts) OVER (PARTITION BY period_start) AS share
               FROM (SELECT time_bucket(INTERVAL '7 days', created_at, TIMESTAMP '1970-01-01') AS period_start,
                            cluster, count(*) AS n_posts FROM clustered GROUP BY ALL)""")
_GRID = ("grid", """SELECT c.cluster, g.period_start, coalesce(tl.n_posts, 0) AS n_posts,
                           coalesce(tl.share, 0.0) AS share
    FROM (SELECT DISTINCT cluster FROM tl) c,
         (SELECT unnest(generate_series((SELECT min(period_start) FROM tl), (SELECT max(period_start) FROM tl),
                                        INTERVAL '7 days')) AS period_start) g
    LEFT JOIN tl ON tl.cluster = c.cluster AND tl.period_start = g.period_start""")
_DELTA = ("delta", """SELECT *, lag(share) OVER (PARTITION BY cluster ORDER BY period_start) AS prev_share FROM grid""")


@register("drift_timeline", sql("SELECT period_start, cluster, n_posts, round(share, 6) AS share FROM tl",
                                "clustered", extra=[_TL]))
def q_drift_timeline(spark, sf):
    t = dr.drift_timeline(fx.clustered(spark, sf))
    return t.select("period_start", "cluster", "n_posts", _r(F.col("share")).alias("share"))


@register("drift_delta", sql("""SELECT period_start, cluster, n_posts, round(share, 6) AS share,
                                       round(prev_share, 6) AS prev_share, round(share - prev_share, 6) AS delta
                                FROM delta""", "clustered", extra=[_TL, _GRID, _DELTA]))
def q_drift_delta(spark, sf):
    d = dr.drift_delta(fx.clustered(spark, sf))
    return d.select("period_start", "cluster", "n_posts", *[_r(F.col(c)).alias(c) for c in
                                                            ("share", "prev_share", "delta")])


@register("drift_jsd", sql("""
    SELECT period_start, round(sum((CASE WHEN prev_share > 0 THEN prev_share * ln(prev_share / ((prev_share + share) / 2)) ELSE 0 END
                               + CASE WHEN share > 0 THEN share * ln(share / ((prev_share + share) / 2)) ELSE 0 END) / 2), 6) AS jsd
    FROM delta WHERE prev_share IS NOT NULL GROUP BY period_start""", "clustered", extra=[_TL, _GRID, _DELTA]))
def q_drift_jsd(spark, sf):
    return dr.drift_jsd(fx.clustered(spark, sf)).select("period_start", _r(F.col("jsd")).alias("jsd"))


@register("centroid_shift", sql(f"""
    SELECT a.period_start, b.period_start AS prev_start, a.cluster,
           round(1 - CASE WHEN {norm('a.center')} > 0 AND {norm('b.center')} > 0
                          THEN {dotp('a.center', 'b.center')} / ({norm('a.center')} * {norm('b.center')}) ELSE 0 END, 6) AS shift
    FROM (SELECT *, lag(period_start) OVER (PARTITION BY cluster ORDER BY period_start) AS prev FROM pm) a
    JOIN pm b ON b.cluster = a.cluster AND b.period_start = a.prev""", "clustered", extra=[
    ("pm", """SELECT period_start, cluster, list(m ORDER BY pos) AS center FROM (
        SELECT period_start, cluster, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
          SELECT time_bucket(INTERVAL '7 days', created_at, TIMESTAMP '1970-01-01') AS period_start, cluster,
                 unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM clustered)
        GROUP BY ALL) GROUP BY period_start, cluster""")]))
def q_centroid_shift(spark, sf):
    s = dr.centroid_shift(fx.clustered(spark, sf, with_embedding=True))
    return s.select("period_start", "prev_start", "cluster", _r(F.col("shift")).alias("shift"))


# --------------------------------------------------------------- flagship ---

def _summary_sql(src: str) -> tuple[str, str]:
    return ("summary", f"""
    SELECT l.cluster, l.label, coalesce(p.n, 0) AS n_posts,
           round_even(coalesce(p.n, 0) / (SELECT count(*) FROM {src}) * 100, 1) AS pct,
           substring(p.first_text, 1, 150) AS sample,
           chr(10) || 'Cluster "' || l.label || '" ('
             || CAST(round_even(coalesce(p.n, 0) / (SELECT count(*) FROM {src}) * 100, 1) AS VARCHAR)
             || '% of posts):' || chr(10) || '  e.g. "' || substring(p.first_text, 1, 150) || '"' || chr(10) AS line
    FROM (SELECT DISTINCT cluster, 'Theme ' || CAST(cluster AS VARCHAR) AS label FROM {src}) l LEFT JOIN (
      SELECT cluster, count(*) AS n, arg_min(text, ord) FILTER (WHERE text IS NOT NULL) AS first_text
      FROM {src} GROUP BY cluster) p USING (cluster)""")


_THEMED = [
    ("dp", "SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1"),
    ("pv", f"SELECT dp.*, {l2n('v.embedding')} AS v, v.embedding FROM dp JOIN vectors v "
           "ON v.ord = CAST(dp.id AS BIGINT) % (SELECT count(*) FROM vectors)"),
    _assign_sql("pv", "centroids", "pa"),
    ("themed", "SELECT pv.id, pv.text, pv.ord, pv.score, pv.embedding, pa.cluster FROM pv JOIN pa USING (id)"),
]


def themed_posts(spark, sf) -> DataFrame:
    """Every deduplicated post with a vector (row id % number of vectors), assigned to the nearest centre."""
    posts = ing.dedup_first(fx.posts(spark, sf))
    v = fx.vectors(spark, sf)
    keyed = posts.withColumn("vec", F.col("id").cast("long") % v.select(F.count(F.lit(1))).scalar())
    v = v.select(F.col("ord").alias("vec"), "embedding")
    return cl.assign_nearest(keyed.join(v, "vec").drop("vec"), cl.centres_literal(fx.centroids(spark, sf)))


def _plane_sql(turn: str) -> str:
    return (f"round(list_sum(list_transform(t.embedding, lambda e, i: CAST(e AS DOUBLE) * {turn}((i - 1) % {PLANE_TURN}))), 6)")


PLANE_TURN = 7


def plane(v, turn):
    """One axis of a fixed plane: the dot product with turn(0), turn(1), .. turn(6), turn(0), .."""
    return F.aggregate(F.transform(v, lambda e, i: e.cast("double") * turn((i % PLANE_TURN).cast("double"))),
                       F.lit(0.0), lambda a, x: a + x)


@register("theme_summary", sql("SELECT * FROM summary", "posts", "vectors", "centroids",
                               extra=_THEMED + [_summary_sql("themed")]))
def q_theme_summary(spark, sf):
    return rp.cluster_summary(themed_posts(spark, sf))


@register("cluster_layout_join", sql("""
    SELECT t.id, t.cluster, 'Cluster ' || CAST(t.cluster AS VARCHAR) AS cluster_name,
           'Theme ' || CAST(t.cluster AS VARCHAR) AS label,
           """ + _plane_sql("cos") + " AS x, " + _plane_sql("sin") + """ AS y,
           substring(t.text, 1, 150) || '...' AS text_150, t.score
    FROM themed t""", "posts", "vectors", "centroids", extra=_THEMED))
def q_cluster_layout_join(spark, sf):
    t = themed_posts(spark, sf)
    layout = t.select("id", _r(plane("embedding", F.cos)).alias("x"), _r(plane("embedding", F.sin)).alias("y"))
    j = rp.label_lookup(t, fx.cluster_labels(t)).join(layout, "id")
    return j.select("id", "cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("cluster_name"),
                    "label", "x", "y", tx.preview("text", rp.HOVER_CHARS_APP).alias("text_150"), "score")


# -------------------------------------------------------------- streaming ---

STREAM_FILES = 4
STREAM_DELAY = "31 days"   # how long repeated ids are known, by landing time
DRIFT_DELAY = "3 days"     # rows later than this are counted from the side table


@register("stream_ingest", sql("SELECT DISTINCT id FROM posts", "posts"))
def q_stream_ingest(spark, sf):
    """Hits landed as JSON page files → streaming posts → dedup within the watermark
    on the landing time: posts without a time of their own are kept."""
    root = scratch_path(spark, "stream-ingest")
    pages = hs.pages_as_json(fx.hits(spark, sf))
    files = st.landed_files(fx.read_table(spark, sf, "documents", ["text"]), STREAM_FILES)
    pages.repartition(files).write.mode("overwrite").text(f"{root}/in")
    posts = st.dedup_stream(st.ingest_stream(spark, f"{root}/in"), STREAM_DELAY)
    st.run_available_now(posts.select("id", "landed_at"), f"{root}/out", f"{root}/chk")
    return spark.read.parquet(f"{root}/out").select("id")


@register("stream_assign", sql("SELECT id, cluster, round(d2, 6) AS sq_dist FROM a0",
                               "vectors", "centroids", extra=[_NV, _assign_sql("nv", "centroids", "a0")]))
def q_stream_assign(spark, sf):
    root = scratch_path(spark, "stream-assign")
    v = fx.vectors(spark, sf).select("id", "embedding", "ord")
    st.write_stream_input(v, f"{root}/in", STREAM_FILES)
    s = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    a = st.assign_stream(s, cl.centres_literal(fx.centroids(spark, sf)))
    st.run_available_now(a.select("id", "cluster", "sq_dist"), f"{root}/out", f"{root}/chk")
    return spark.read.parquet(f"{root}/out").select("id", "cluster", _r(F.col("sq_dist")).alias("sq_dist"))


@register("stream_drift", sql("""
    SELECT time_bucket(INTERVAL '7 days', created_at, TIMESTAMP '1970-01-01') AS period_start,
           cluster, count(*) AS n_posts FROM clustered GROUP BY ALL""", "clustered"))
def q_stream_drift(spark, sf):
    root = scratch_path(spark, "stream-drift")
    c = fx.clustered(spark, sf).select("id", "created_at", "cluster", F.xxhash64("id").alias("ord"))
    st.write_stream_input(c, f"{root}/in", STREAM_FILES)          # files in no order of time
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    st.run_batches(s, st.drift_with_late_batch(spark, f"{root}/out", "7 days", DRIFT_DELAY), f"{root}/chk")
    return st.drift_counts_corrected(spark, f"{root}/out")


@register("stream_keep_first", sql("""
    SELECT id, text, source, platform, created_at, score, url, ord, content_type
    FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""", "posts"))
def q_stream_keep_first(spark, sf):
    """Pages landed in no order, a quarter of the files a micro-batch → whole first posts by id, as batch dedup keeps them."""
    root = scratch_path(spark, "stream-keep-first")
    pages = hs.pages_as_json(fx.hits(spark, sf))
    files = st.landed_files(fx.read_table(spark, sf, "documents", ["text"]), STREAM_FILES)
    pages.repartition(files, F.xxhash64("json")).write.mode("overwrite").text(f"{root}/in")
    posts = st.keep_first_stream(st.ingest_stream(spark, f"{root}/in", files // STREAM_FILES), "1 day")
    st.run_updates(posts, f"{root}/out", f"{root}/chk")
    return st.kept_first(spark, f"{root}/out", posts.schema)


@register("stream_centres", None)
def q_stream_centres(spark, sf):
    """Decayed centre updates per micro-batch, starting from the per-label means."""
    root = scratch_path(spark, "stream-centres")
    fx.centroids(spark, sf).select("cluster", "center", F.lit(0.0).alias("weight")) \
        .write.parquet(f"{root}/centres/version=-1")
    v = fx.vectors(spark, sf).select("id", "embedding", "ord")
    st.write_stream_input(v, f"{root}/in", STREAM_FILES)
    s = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = (s.writeStream.foreachBatch(st.update_centres_batch(f"{root}/centres", decay=0.9))
         .option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    c = spark.read.parquet(f"{root}/centres")
    last = c.select(F.max("version")).scalar()
    return _explode_centres(c.where(F.col("version") == last).select("cluster", "center"))


CENTRAL_N = 5


@register("central_samples", sql(f"""
    SELECT id, cluster, rank, round(d2, 6) AS sq_dist FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY d2, id) AS INTEGER) AS rank FROM a0)
    WHERE rank <= {CENTRAL_N}""", "vectors", "centroids", extra=[_NV, _assign_sql("nv", "centroids", "a0")]))
def q_central_samples(spark, sf):
    """The n posts nearest to each centre (the README's "from the center of each cluster")."""
    a = _assigned(spark, sf)
    c = ing.first_n_per_group(a, "cluster", CENTRAL_N, [F.col("sq_dist"), F.col("id")], rank_col="rank")
    return c.select("id", "cluster", "rank", _r(F.col("sq_dist")).alias("sq_dist"))
