"""Golden micro-tables for the string projections.

The expected values come from a plain-Python restatement of the behaviour
being matched (regex tag strip, five entities in order, str.split collapse).
"""

import re

import pytest
from pyspark.sql import functions as F

from themescope.functions import text as tx


def py_clean(s):
    if not s:
        return ""
    s = re.sub(r"<[^>]+>", " ", s)
    for a, b in tx.ENTITIES:
        s = s.replace(a, b)
    return " ".join(s.split()).strip()


EDGE = [
    "a &amp;lt;b&amp;gt; c", "x<y and z>w", "keep <> this", "unclosed <b tag",
    "tag <a\nhref='x'>across</a> lines", "sep\x1fhere\x1cand nbsp em　ideo",
    "slash &#x2F; stays &#x27;q&#x27; &quot;d&quot;", "   ", "", None,
    "zero​width stays", "tab\tnew\nline\r\x0bvt\x0cff\x85nel",
]


def test_clean_text_edge_strings(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i INT, s STRING")
    got = {r.i: r.c for r in df.select("i", tx.clean_text("s").alias("c")).collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == py_clean(s), (i, s)


def test_clean_pages_all_rows_match_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", tx.clean_text("html").alias("c")).collect()
    assert all(r.c == py_clean(r.html) for r in rows)


@pytest.mark.parametrize("n,keep", [(39, False), (40, True)])
def test_min_length_boundary(spark, n, keep):
    from themescope.sources.hits import hits_to_posts
    text = "x" * n
    h = spark.createDataFrame([("comment", 0, 0, "1", None, None, text, 5, 3, None, 1)],
                              "content_type STRING, page INT, pos INT, objectID STRING, title STRING, "
                              "story_text STRING, comment_text STRING, created_at_i BIGINT, points BIGINT, "
                              "url STRING, ord BIGINT")
    assert (hits_to_posts(h).count() == 1) == keep


def test_dataset_key_long_topic_with_slash(spark):
    topic = "Is AI/ML overhyped in the year of 2026?"      # 39 characters
    r = spark.range(1).select(tx.dataset_key(F.lit(topic)).alias("k")).first()
    assert r.k == topic[:30].replace(" ", "_").replace("/", "-")


def test_preview_and_escape(spark):
    r = spark.range(1).select(
        tx.preview(F.lit("short"), 120).alias("p"),
        tx.preview(tx.html_escape_display(F.lit('a "b" <c> & d')), 8).alias("q"),
        tx.preview(F.lit(None).cast("string"), 10).alias("n")).first()
    assert r.p == "short..."
    assert r.q == ('a "b" <c> & d'.replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;"))[:8] + "..."
    assert r.n is None


def test_percent_ties_to_even(spark):
    r = spark.range(1).select(
        tx.percent_1dp(F.lit(1), F.lit(16)).alias("a"),      # 6.25 -> 6.2
        tx.percent_1dp(F.lit(1), F.lit(3)).alias("b"),
        tx.percent_1dp(F.lit(1), F.lit(0)).alias("z")).first()
    assert r.a == 6.2 and r.b == 33.3 and r.z is None


@pytest.mark.parametrize("sim,band", [(0.6, "loosely related"), (0.6000001, "very similar"),
                                      (0.3, "unrelated"), (0.31, "loosely related"), (-1.0, "unrelated")])
def test_similarity_bands_strict(spark, sim, band):
    r = spark.range(1).select(tx.similarity_band(F.lit(sim)).alias("b")).first()
    assert r.b == band


def test_strip_all_unicode(spark):
    r = spark.range(1).select(tx.strip_all(F.lit(" \t label 　\n")).alias("s")).first()
    assert r.s == "label"


def test_numbered_lines(spark):
    r = spark.range(1).select(tx.numbered_lines(F.array(F.lit("abc"), F.lit("defgh")), 3).alias("s")).first()
    assert r.s == "1. abc\n2. def"


def test_blank_topic_rejected(spark):
    import pytest as _pytest
    from themescope.operators import report as rp
    for bad in ("", "   ", "　\n", None):
        with _pytest.raises(ValueError):
            rp.require_topic(bad)
    t = spark.createDataFrame([("AI",), ("  ",), (None,), (" ",)], "topic STRING")
    assert [r.topic for r in rp.valid_topics(t).collect()] == ["AI"]
