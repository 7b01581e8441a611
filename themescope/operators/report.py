"""Per-cluster aggregates and the report evidence tables (AGG-*, RPT-*, ORD-4..7).

The reference rescans the table once per cluster; here every per-cluster
figure is one ``groupBy``/window over all clusters.  Cluster-level results
have k rows; the few string aggregations over them (summary, report) are
bounded by k, never by the number of posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.functions.text import (html_escape_display, numbered_lines, percent_1dp,
                                       preview, terms, year_month)
from themescope.operators.ingest import first_n_per_group

# --- fixed values (formats that must equal the reference's output) ---------
SAMPLES_PER_LABEL = 8          # posts per cluster handed to the labeler
SAMPLE_CHARS = 200             # each cut to 200 characters
SUMMARY_SAMPLE_CHARS = 150     # first sample per cluster in the report prompt
PROFILE_SAMPLES = 3            # samples printed per cluster in the profile
QUOTES_PER_CLUSTER = 5         # quote cards per cluster
QUOTE_CHARS = 350
HOVER_CHARS_PLOT = 120         # scatter hover text, CLI plot
HOVER_CHARS_APP = 150          # scatter hover text, dashboard
PREVIEW_ROWS = 10
TITLE_RULE = "=" * 60
SECTION_RULE = "-" * 30
LABEL_PROMPT = (
    "You are analyzing online discussion posts grouped by semantic similarity.\n\n"
    "Here are posts from one group:\n{samples}\n\n"
    "Give this group a short, specific label (4-7 words) that captures the dominant opinion or narrative.\n"
    "Reply with ONLY the label. No explanation, no punctuation at the end.")
SUMMARY_LINE = '\nCluster "{label}" ({pct}% of posts):\n  e.g. "{sample}"\n'
REPORT_PROMPT = (
    "You are an analyst summarizing public opinion from Hacker News discussions.\n\n"
    'Topic: "{topic}"\nTotal posts analyzed: {total}\n\n'
    "Opinion clusters discovered:\n{summary}\n\n"
    'Write a 150-200 word plain-English "State of Discourse" report that:\n'
    "- Describes the dominant narratives people hold about this topic\n"
    "- Notes which viewpoints are most and least common\n"
    "- Highlights tensions or contradictions between clusters\n"
    "- Ends with one sentence on where the conversation is heading\n\n"
    "Flowing paragraphs only, no bullet points.")
REPORT_TITLE = "OPINION DRIFT REPORT: {topic}"
# ---------------------------------------------------------------------------


def _fmt(template: str, **cols) -> F.Column:
    """Fill a ``{name}`` template from columns with ``format_string``."""
    import re
    names = re.findall(r"{(\w+)}", template)
    fmt = re.sub(r"{\w+}", "%s", template.replace("%", "%%"))
    return F.format_string(fmt, *[cols[n].cast("string") for n in names])


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_posts"))


def cluster_sizes_dense(clustered: DataFrame, k: int) -> DataFrame:
    """Every id 0..k-1, empty ones with 0 posts (left join from ``range``)."""
    ids = clustered.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return (ids.join(cluster_sizes(clustered), "cluster", "left")
            .select("cluster", F.coalesce("n_posts", F.lit(0)).alias("n_posts")))


def _k_total(col: str) -> F.Column:
    """Sum of ``col`` over a k-row per-cluster result (one small window; the
    input is already aggregated, so this never gathers posts)."""
    return F.sum(col).over(Window.partitionBy())


def cluster_share(clustered: DataFrame) -> DataFrame:
    """(cluster, n_posts, pct) with pct = round(n / total * 100, 1), ties to even."""
    sizes = cluster_sizes(clustered)
    return sizes.select("cluster", "n_posts", percent_1dp(F.col("n_posts"), _k_total("n_posts")).alias("pct"))


def corpus_stats(clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count(F.lit(1)).alias("n_posts"),
                         F.count_distinct("cluster").alias("n_clusters"))


def date_range(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("n_posts"),
                     year_month(F.min("created_at")).alias("first_month"),
                     year_month(F.max("created_at")).alias("last_month"))


def vector_shape(vectors: DataFrame, vec_col: str = "embedding", bytes_per_value: int = 4) -> DataFrame:
    """Rows, dimension range (a dimension check when min = max) and payload bytes."""
    s = F.size(vec_col)
    return vectors.agg(F.count(F.lit(1)).alias("n_rows"), F.min(s).alias("dim_min"),
                       F.max(s).alias("dim_max"), (F.sum(s) * bytes_per_value).alias("n_bytes"))


def preview_rows(posts: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` posts by arrival (a top-n, planned as TakeOrderedAndProject)."""
    return posts.orderBy("ord").limit(n).select("source", "score", "created_at", "text")


def first_texts(clustered: DataFrame, n: int) -> DataFrame:
    """First ``n`` non-null texts of every cluster, with their rank."""
    return first_n_per_group(clustered.where(F.col("text").isNotNull()), "cluster", n,
                             ["ord"], rank_col="rank")


def _ordered_texts(ranked: DataFrame, value) -> F.Column:
    """Array of ``value`` ordered by rank (groups hold at most n rows)."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))),
                       lambda x: x["v"])


def cluster_samples(clustered: DataFrame, n: int = SAMPLES_PER_LABEL,
                    width: int = SAMPLE_CHARS) -> DataFrame:
    """(cluster, samples): ``"1. …\\n2. …"`` of the first n texts, each cut."""
    r = first_texts(clustered, n)
    return r.groupBy("cluster").agg(numbered_lines(_ordered_texts(r, F.col("text")), width).alias("samples"))


def label_prompts(samples: DataFrame) -> DataFrame:
    return samples.select("cluster", _fmt(LABEL_PROMPT, samples=F.col("samples")).alias("prompt"))


def cluster_profile(clustered: DataFrame, k: int, n: int = PROFILE_SAMPLES,
                    width: int = SAMPLE_CHARS) -> DataFrame:
    """Size and first ``n`` posts for every cluster id 0..k-1 (empty included)."""
    r = first_n_per_group(clustered, "cluster", n, ["ord"], rank_col="rank")
    samples = r.groupBy("cluster").agg(F.array_join(
        _ordered_texts(r, F.concat(F.lit("  • "), F.substring("text", 1, width))), "\n").alias("samples"))
    dense = cluster_sizes_dense(clustered, k)
    return (dense.join(samples, "cluster", "left")
            .select("cluster", "n_posts",
                    F.format_string("CLUSTER %d (%d posts)", "cluster", "n_posts").alias("header"),
                    F.coalesce("samples", F.lit("")).alias("samples")))


def label_lookup(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach the cluster label; ``labels`` has one row per cluster (k rows),
    so AQE turns this into a broadcast hash join from the measured size."""
    return clustered.join(labels, "cluster", "left")


def hover_preview(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows behind the scatter plot hover: names, cut text, score."""
    j = label_lookup(clustered, labels)
    return j.select("id", "cluster",
                    F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("cluster_name"),
                    "label",
                    preview("text", HOVER_CHARS_PLOT).alias("text_120"),
                    preview("text", HOVER_CHARS_APP).alias("text_150"), "score")


def quote_cards(clustered: DataFrame, labels: DataFrame, n: int = QUOTES_PER_CLUSTER,
                width: int = QUOTE_CHARS) -> DataFrame:
    """First ``n`` texts per cluster, display-escaped, then cut, then '...'."""
    r = first_texts(clustered, n)
    return (label_lookup(r, labels).select(
        "cluster", "rank",
        F.format_string("CLUSTER %d // %s", "cluster", "label").alias("heading"),
        preview(html_escape_display("text"), width).alias("quote")))


def default_labels(per_cluster: DataFrame) -> DataFrame:
    """'Theme <id>' for every cluster of a per-cluster table."""
    return per_cluster.withColumn("label", F.concat(F.lit("Theme "), F.col("cluster").cast("string")))


def cluster_summary(clustered: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per cluster: label, size, share, first non-null sample (150 chars) and
    the summary line the report prompt is built from.

    One aggregate over the posts; shares come from a window over its k rows.
    Without ``labels`` every present cluster is named 'Theme <id>'; with a
    labels table, its clusters are kept even when empty.
    """
    per = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.min_by(F.col("text"), F.when(F.col("text").isNotNull(), F.col("ord"))).alias("first_text"))
    j = default_labels(per) if labels is None else labels.join(per, "cluster", "left")
    n = F.coalesce("n_posts", F.lit(0))
    j = j.withColumn("n_posts", n).withColumn("pct", percent_1dp(F.col("n_posts"), _k_total("n_posts")))
    sample = F.substring("first_text", 1, SUMMARY_SAMPLE_CHARS)
    return j.select("cluster", "label", "n_posts", "pct", sample.alias("sample"),
                    _fmt(SUMMARY_LINE, label=F.col("label"), pct=F.col("pct"), sample=sample).alias("line"))


def require_topic(topic: str | None) -> str:
    """A blank topic is rejected before any job runs."""
    if topic is None or not str(topic).strip():
        raise ValueError("topic is blank")
    return topic


def valid_topics(topics: DataFrame, col: str = "topic") -> DataFrame:
    """Rows of a topics table whose topic is not blank (Unicode whitespace aware)."""
    from themescope.functions.text import strip_all
    return topics.where(F.col(col).isNotNull() & (strip_all(col) != ""))


def report_prompt(summary: DataFrame, topic: str) -> DataFrame:
    """One row: total, the concatenated summary (cluster order) and the prompt."""
    require_topic(topic)
    agg = summary.agg(
        F.sum("n_posts").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "line"))),
                                 lambda x: x["line"]), "").alias("summary"))
    return agg.select("total", "summary",
                      _fmt(REPORT_PROMPT, topic=F.lit(topic), total=F.col("total"),
                           summary=F.col("summary")).alias("prompt"))


def template_report(summary: DataFrame) -> DataFrame:
    """Default report body without a language model: dominant and smallest
    theme with their shares and first samples (one row, ``report``)."""
    ranked = summary.agg(
        F.max_by(F.struct("label", "pct", "sample"), F.struct("n_posts", -F.col("cluster"))).alias("top"),
        F.min_by(F.struct("label", "pct", "sample"), F.struct("n_posts", F.col("cluster"))).alias("low"),
        F.sum("n_posts").alias("total"), F.count(F.lit(1)).alias("k"))
    text = F.format_string(
        'Across %d posts in %d themes, the most common view is "%s" (%s%% of posts), e.g. "%s". '
        'The least common is "%s" (%s%% of posts), e.g. "%s".',
        "total", "k", "top.label", F.col("top.pct").cast("string"), "top.sample",
        "low.label", F.col("low.pct").cast("string"), "low.sample")
    return ranked.select(text.alias("report"))


def report_lines(labels: DataFrame, report: DataFrame, topic: str) -> DataFrame:
    """Lines of the saved report file as (line_no, line) rows."""
    require_topic(topic)
    spark = labels.sparkSession
    head = spark.createDataFrame(
        [(0, REPORT_TITLE.format(topic="")), (1, TITLE_RULE), (2, ""), (3, "CLUSTER LABELS"),
         (4, SECTION_RULE)], "line_no INT, line STRING")
    head = head.withColumn("line", F.when(F.col("line_no") == 0,
                                          F.concat(F.col("line"), F.upper(F.lit(topic))))
                           .otherwise(F.col("line")))
    body_start = 1_000_000                                 # behind any number of clusters
    labels_l = labels.select((F.lit(5) + F.col("cluster")).cast("int").alias("line_no"),
                             F.format_string("  Cluster %d: %s", "cluster", "label").alias("line"))
    tail = spark.createDataFrame(
        [(body_start - 4, ""), (body_start - 3, ""), (body_start - 2, "STATE OF DISCOURSE"),
         (body_start - 1, SECTION_RULE)], "line_no INT, line STRING")
    body = report.select(F.posexplode(F.split("report", "\n")).alias("p", "line")).select(
        (F.lit(body_start) + F.col("p")).cast("int").alias("line_no"), "line")
    return head.unionByName(labels_l).unionByName(tail).unionByName(body)


def keyword_labels(clustered: DataFrame, top: int = 5, min_len: int = 4,
                   stop_words: list[str] | None = None) -> DataFrame:
    """Class-based TF-IDF labels: the ``top`` terms of each cluster.

    score(t, c) = tf(t, c) · ln(1 + A / f(t)), A = average term count per
    cluster, f(t) = count of t over all clusters; rounded to 6 places, ties
    by term.  Term counts are one partial/final aggregate on (cluster, term);
    f(t) is a sum over a window partitioned by term — bounded, since after
    that aggregate a term has at most one row per cluster — which saves
    re-tokenising for a separate aggregate and join.
    """
    toks = clustered.select("cluster", F.explode(terms("text", min_len)).alias("term"))
    if stop_words:
        toks = toks.where(~F.col("term").isin(*stop_words))
    tf = toks.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    a = tf.select((F.sum("tf") / F.count_distinct("cluster")).alias("a")).scalar()
    f = F.sum("tf").over(Window.partitionBy("term"))
    scored = tf.withColumn("score", F.round(F.col("tf") * F.log(1 + a / f), 6))
    best = first_n_per_group(scored, "cluster", top, [F.col("score").desc(), "term"], rank_col="rank")
    return best.groupBy("cluster").agg(
        F.array_join(_ordered_texts(best, F.col("term")), ", ").alias("keywords"))
