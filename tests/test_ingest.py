"""Arrival-order semantics: dedup keep-first, quota before dedup, paging stop."""

from pyspark.sql import functions as F

from themescope.operators import ingest as ing
from themescope.sources import hits as hs

HIT_DDL = ("content_type STRING, page INT, pos INT, objectID STRING, title STRING, story_text STRING, "
           "comment_text STRING, created_at_i BIGINT, points BIGINT, url STRING, ord BIGINT")
LONG = "this is a post that is comfortably longer than forty characters"


def hit(ct, page, pos, oid, text=LONG, url=None, ts=100, pts=1):
    rank = 0 if ct == "story" else 1
    ordv = rank * 10**12 + page * 10**6 + pos
    if ct == "story":
        return (ct, page, pos, oid, text, None, None, ts, pts, url, ordv)
    return (ct, page, pos, oid, None, None, text, ts, pts, url, ordv)


def test_duplicate_id_across_types_keeps_story(spark):
    h = spark.createDataFrame([hit("comment", 0, 0, "7"), hit("story", 0, 5, "7")], HIT_DDL)
    out = ing.dedup_first(hs.hits_to_posts(h)).collect()
    assert len(out) == 1 and out[0].content_type == "story"


def test_null_ids_form_one_group(spark):
    h = spark.createDataFrame([hit("comment", 0, 0, None), hit("comment", 0, 1, None)], HIT_DDL)
    out = ing.dedup_first(hs.hits_to_posts(h)).collect()
    assert len(out) == 1 and out[0].url.endswith("id=None")


def test_quota_counts_before_dedup_and_odd_max(spark):
    rows = [hit("story", 0, i, str(i % 2)) for i in range(4)] + [hit("comment", 0, i, f"c{i}") for i in range(4)]
    h = spark.createDataFrame(rows, HIT_DDL)
    p = hs.hits_to_posts(h)
    q = ing.type_quota(p, 5)                 # 5 // 2 = 2 per type
    assert q.groupBy("content_type").count().where("count = 2").count() == 2
    # both story rows kept by the quota are the ids "0" and "1" -> dedup keeps both
    assert ing.dedup_first(q).count() == 4


def test_url_defaults_and_missing_values(spark):
    h = spark.createDataFrame([hit("comment", 0, 0, "1", url=""), hit("comment", 0, 1, "2", url=None),
                               hit("comment", 0, 2, "3", url="https://x.test/", ts=None, pts=None)], HIT_DDL)
    out = {r.id: r for r in hs.hits_to_posts(h).collect()}
    assert out["1"].url == hs.ITEM_URL_PREFIX + "1"
    assert out["2"].url == hs.ITEM_URL_PREFIX + "2"
    assert out["3"].url == "https://x.test/" and out["3"].score == 0
    assert out["3"].created_at.year == 1970


def test_story_text_concatenation(spark):
    h = spark.createDataFrame([("story", 0, 0, "9", None, "<p>" + LONG, None, 1, 1, None, 0)], HIT_DDL)
    assert hs.hits_to_posts(h).first().text == LONG


def test_paging_stops_at_first_empty_page(spark):
    rows = [hit("story", p, 0, f"s{p}") for p in (0, 1, 3)] + [hit("comment", p, 0, f"c{p}") for p in (1, 2)]
    h = spark.createDataFrame(rows, HIT_DDL)
    stops = {r.content_type: r.stop_page for r in ing.stop_pages(h).collect()}
    assert stops == {"story": 2, "comment": 0}
    kept = ing.pages_before_stop(h).select("objectID").collect()
    assert sorted(r.objectID for r in kept) == ["s0", "s1"]


def test_quota_plan_limits_before_shuffle(spark):
    h = spark.createDataFrame([hit("story", 0, i, str(i)) for i in range(10)], HIT_DDL)
    plan = ing.type_quota(hs.hits_to_posts(h), 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dataset_gate_semi_and_anti(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "dataset STRING, x INT")
    assert {r.dataset for r in ing.dataset_gate(df, 2).collect()} == {"a"}
    assert {r.dataset for r in ing.dataset_rejects(df, 2).collect()} == {"b"}


def test_topic_search_pages(spark):
    texts = ["alpha beta gamma words words words words words", "beta alpha alpha filler filler filler",
             "gamma only here and nothing else at all in it", "ALPHA, beta! and more text to be long"]
    rows = [hit("comment", 0, i, str(i), text=t) for i, t in enumerate(texts)]
    p = hs.hits_to_posts(spark.createDataFrame(rows, HIT_DDL), min_chars=0)
    page0 = hs.topic_search_page(p, "Alpha beta", "comment", 0, hits_per_page=2).orderBy("rank").collect()
    assert [r.id for r in page0] == ["1", "0"]          # 3 matches, then 2 matches (earliest)
    page1 = hs.topic_search_page(p, "Alpha beta", "comment", 1, hits_per_page=2).collect()
    assert [r.id for r in page1] == ["3"]
