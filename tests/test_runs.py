"""End-to-end runs: scrape over landed page files, then the theme map."""

import math
import os

from pyspark.sql import functions as F

from themescope import fixtures as fx
from themescope.plans import runs
from themescope.sources import hits as hs
from tests.conftest import SF_SMALL


def test_scrape_landed_pages_equals_table_path(spark, tmp_dir):
    hits = fx.hits_gap(spark, SF_SMALL)
    hs.pages_as_json(hits).write.text(os.path.join(tmp_dir, "pages"))
    from_files = runs.scrape_landed_pages(spark, os.path.join(tmp_dir, "pages"), 60)
    from_table = runs.scrape_phase(hits, 60)
    cols = ["id", "text", "created_at", "score", "url", "ord"]
    assert sorted(from_files.select(cols).collect()) == sorted(from_table.select(cols).collect())
    assert from_files.groupBy("content_type").count().where("count > 30").count() == 0


def test_gate_stops_small_runs(spark):
    import pytest
    small = fx.posts(spark, SF_SMALL).limit(5)
    with pytest.raises(ValueError):
        runs.gate(small, 20)


def test_theme_map_end_to_end(spark):
    from themescope.operators.ingest import dedup_first
    posts = dedup_first(fx.posts(spark, SF_SMALL))           # a run's input has unique ids
    vectors = fx.vectors(spark, SF_SMALL).select("id", "embedding")
    tm = runs.theme_map(posts, "AI / hype, a topic longer than thirty chars", k=3,
                        vectors=vectors, n_init=2)
    n = tm.clustered.count()
    assert n == posts.join(vectors, "id").count()
    assert sorted(r.cluster for r in tm.summary.collect()) == [0, 1, 2]
    assert abs(sum(r.pct for r in tm.shares.collect()) - 100) < 0.5
    s = tm.silhouette.first()
    assert -1 <= s.silhouette <= 1 and s.n == n
    assert tm.scatter.count() == n and tm.quotes.count() <= 15
    lines = [r.line for r in tm.report_lines.orderBy("line_no").collect()]
    assert lines[0].startswith("OPINION DRIFT REPORT: AI / HYPE")
    assert math.isfinite(tm.training_cost)
    assert tm.prompt.first().total == n


def test_phase_by_phase_over_files(spark, tmp_dir):
    from themescope.operators.ingest import dedup_first
    from themescope.sources import files as fs
    posts = dedup_first(fx.posts(spark, SF_SMALL)).select("id", "text", "source", "platform",
                                                          "created_at", "score", "url")
    fs.write_csv(posts.coalesce(1), os.path.join(tmp_dir, "ai_hype.csv"))
    shape = runs.embed_phase(spark, os.path.join(tmp_dir, "ai_hype.csv"), os.path.join(tmp_dir, "vec"),
                             topic="ai hype").first()
    assert shape.n_rows == posts.count() and shape.dim_min == shape.dim_max == 384
    curve, profile = runs.cluster_phase(spark, os.path.join(tmp_dir, "ai_hype.csv"),
                                        os.path.join(tmp_dir, "vec"), 3,
                                        os.path.join(tmp_dir, "out", "ai_hype_clustered.csv"),
                                        max_k=3, n_init=2)
    assert [k for k, _ in curve] == [2, 3]
    assert profile.count() == 3 and sum(r.n_posts for r in profile.collect()) == posts.count()
    assert fs.read_clustered(spark, os.path.join(tmp_dir, "out")).where("dataset = 'ai_hype'").count() \
        == posts.count()
    lines = runs.report_phase(spark, os.path.join(tmp_dir, "out"), "ai hype", os.path.join(tmp_dir, "rep"))
    text = [r.line for r in lines.orderBy("line_no").collect()]
    assert text[0] == "OPINION DRIFT REPORT: AI HYPE"
    assert sum(t.startswith("  Cluster ") for t in text) == 3 and text[-1].startswith("Across ")


def test_clustered_file_keeps_arrival_order(spark, tmp_dir):
    from themescope.sources import files as fs
    rows = [(f"p{i}", f"text {i}", "s", "p", None, i, "u", i % 2, i) for i in range(40)]
    schema = "id string, text string, source string, platform string, created_at timestamp, score long, url string, cluster int, ord long"
    path = os.path.join(tmp_dir, "cats_clustered.csv")
    fs.write_csv(spark.createDataFrame(rows, schema).orderBy("id").repartition(3, "id"), path)
    assert {r.id: r.ord for r in fs.read_clustered(spark, tmp_dir).collect()} == {f"p{i}": i for i in range(40)}
    # a file of another writer has no such column: its row order counts
    fs.write_csv(spark.createDataFrame(rows, schema).coalesce(1).drop("ord"), os.path.join(tmp_dir, "dogs_clustered.csv"))
    dogs = fs.read_clustered(spark, tmp_dir).where("dataset = 'dogs'").orderBy("ord").collect()
    assert [r.id for r in dogs] == [f"p{i}" for i in range(40)]


def test_posts_in_several_files_keep_their_order(spark, tmp_dir):
    """Spark packs the largest file first; arrival order is by file name all the same."""
    from themescope.sources import files as fs
    schema = "id string, text string, source string, platform string, created_at timestamp, score long, url string"
    sizes = [10, 400, 60]                                   # the second file is the largest
    ids = iter(range(sum(sizes)))
    for k, n in enumerate(sizes):
        rows = [(f"p{i:04d}", f"text {i}, \"quoted\"\nline", "s", "p", None, i, "u") for i in (next(ids) for _ in range(n))]
        spark.createDataFrame(rows, schema).coalesce(1).write.options(**fs.CSV_OPTIONS).csv(f"{tmp_dir}/part{k}")
        part = next(f for f in os.listdir(f"{tmp_dir}/part{k}") if f.startswith("part-"))
        os.makedirs(f"{tmp_dir}/posts.csv", exist_ok=True)
        os.link(f"{tmp_dir}/part{k}/{part}", f"{tmp_dir}/posts.csv/part-{k:05d}.csv")
    got = fs.in_order(fs.read_posts_csv(spark, f"{tmp_dir}/posts.csv"))
    assert got.columns == [*fs.schemas.POST.names, "ord"]
    rows = sorted(got.collect(), key=lambda r: r.ord)
    assert [r.id for r in rows] == [f"p{i:04d}" for i in range(sum(sizes))] and len({r.ord for r in rows}) == len(rows)
