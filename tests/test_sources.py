"""Sources and sinks: CSV round trips, dataset listing, reports, encoders."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from themescope.operators import encode as en
from themescope.sources import files as fs
from themescope.sources import hits as hs

TRICKY = ['plain', 'with, comma', 'with "quotes"', 'back\\slash', 'multi\nline', '']


def test_csv_round_trip_spark_and_pandas(spark, tmp_dir):
    rows = [(str(i), t, "src", "plat", None, i, f"u{i}") for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, source STRING, platform STRING, "
                                     "created_at TIMESTAMP, score BIGINT, url STRING")
    path = os.path.join(tmp_dir, "posts_csv")
    fs.write_csv(df.coalesce(1), path)
    back = {r.id: r.text for r in fs.read_posts_csv(spark, path).collect()}
    assert [back[str(i)] or "" for i in range(len(TRICKY))] == TRICKY
    part = [f for f in os.listdir(path) if f.endswith(".csv")][0]
    pdf = pd.read_csv(os.path.join(path, part), keep_default_na=False, dtype=str)
    assert pdf["text"].tolist() == TRICKY
    # pandas-written file read by Spark
    pfile = os.path.join(tmp_dir, "pandas", "topic.csv")
    os.makedirs(os.path.dirname(pfile))
    pd.DataFrame({"id": ["1", "2"], "text": TRICKY[1:3], "source": "s", "platform": "p",
                  "created_at": "2024-01-01 00:00:00+00:00", "score": [1, 2], "url": "u"}).to_csv(pfile, index=False)
    got = sorted(r.text for r in fs.read_posts_csv(spark, pfile).collect())
    assert got == sorted(TRICKY[1:3])


def test_list_datasets_excludes_outputs(spark, tmp_dir):
    for name in ("ai_hype.csv", "ai_hype_clustered.csv", "remote.csv"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("id,text\n1,x\n")
    names = sorted(r.dataset for r in fs.list_datasets(spark, tmp_dir).collect())
    assert names == ["ai_hype", "remote"]


def test_read_clustered_tags_dataset(spark, tmp_dir):
    pd.DataFrame({"id": ["1"], "text": ["t"], "source": "s", "platform": "p", "created_at": "2024-01-01 00:00:00",
                  "score": [1], "url": "u", "cluster": [3]}).to_csv(os.path.join(tmp_dir, "a_b_clustered.csv"), index=False)
    with open(os.path.join(tmp_dir, "a_b.csv"), "w") as f:
        f.write("id,text\n9,zzz\n")
    rows = fs.read_clustered(spark, tmp_dir).collect()
    assert len(rows) == 1 and rows[0].dataset == "a_b" and rows[0].cluster == 3


def test_partitioned_sink_by_topic(spark, tmp_dir):
    df = spark.createDataFrame([("1", [0.5, 0.5])], "id STRING, embedding ARRAY<FLOAT>")
    fs.write_table(df, tmp_dir + "/vec", topic="AI / hype")
    assert os.path.isdir(tmp_dir + "/vec/dataset=AI_-_hype")
    assert fs.read_vectors(spark, tmp_dir + "/vec/dataset=AI_-_hype").count() == 1


def test_landed_json_pages(spark, tmp_dir):
    hits = spark.createDataFrame([("story", 0, 0, "1", "t", None, None, 5, None, None, 0)],
                                 "content_type STRING, page INT, pos INT, objectID STRING, title STRING, "
                                 "story_text STRING, comment_text STRING, created_at_i BIGINT, points BIGINT, "
                                 "url STRING, ord BIGINT")
    hs.pages_as_json(hits).write.text(tmp_dir + "/pages")
    flat = hs.flatten_pages(hs.read_response_pages(spark, tmp_dir + "/pages")).first()
    assert flat.objectID == "1" and flat.title == "t" and flat.points is None and flat.ord == 0


def test_report_file(spark, tmp_dir):
    from themescope.operators import report as rp
    labels = spark.createDataFrame([(0, "Theme zero")], "cluster INT, label STRING")
    body = spark.createDataFrame([("line one\nline two",)], "report STRING")
    fs.write_report(rp.report_lines(labels, body, "my topic"), tmp_dir + "/rep")
    part = [f for f in os.listdir(tmp_dir + "/rep") if f.startswith("part-")][0]
    text = open(os.path.join(tmp_dir, "rep", part)).read().splitlines()
    assert text[0] == "OPINION DRIFT REPORT: MY TOPIC" and text[1] == "=" * 60
    assert "  Cluster 0: Theme zero" in text and text[-2:] == ["line one", "line two"]


def test_encode_with_user_encoder(spark):
    def toy_encoder():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("1", "a b c"), ("2", None)], "id STRING, text STRING")
    out = {r.id: r.embedding for r in en.encode(df, toy_encoder).collect()}
    assert out["1"] == [5.0, 2.0] and out["2"] == [0.0, 0.0]


def test_apply_labeler_strips(spark):
    df = spark.createDataFrame([(0, "prompt")], "cluster INT, prompt STRING")
    out = en.apply_labeler(df, lambda: (lambda p: f"  Label for {p}\n")).first()
    assert out.label == "Label for prompt"


def test_hashing_encoder_unit_vectors(spark):
    df = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma delta")], "id STRING, text STRING")
    rows = en.hashing_encoder(df, dim=16).collect()
    assert len(rows) == 2
    assert all(len(r.embedding) == 16 for r in rows)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 or np.linalg.norm(r.embedding) == 0 for r in rows)


def test_hashing_encoder_matches_python_tfidf(spark):
    import hashlib
    import math
    import re
    texts = {"a": "Alpha beta beta, gamma!", "b": "beta delta", "c": "", "d": None, "e": "Zeta zeta alpha"}
    df = spark.createDataFrame(list(texts.items()), "id STRING, text STRING")
    dim = 32
    tf = {}
    for k, t in texts.items():
        counts = {}
        for term in [x for x in re.split(r"[^a-zA-Z]+", (t or "").lower()) if x]:
            b = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim
            counts[b] = counts.get(b, 0) + 1
        tf[k] = counts
    dfreq = {}
    for counts in tf.values():
        for b in counts:
            dfreq[b] = dfreq.get(b, 0) + 1
    want = {}
    for k, counts in tf.items():
        v = np.zeros(dim)
        for b, c in counts.items():
            v[b] = c * math.log((len(texts) + 1) / (dfreq[b] + 1))
        n = np.linalg.norm(v)
        want[k] = v / n if n > 0 else v
    got = {r.id: np.array(r.embedding) for r in en.hashing_encoder(df, dim=dim, dtype="double").collect()}
    assert set(got) == set(texts)
    for k in texts:
        assert np.allclose(got[k], want[k], atol=1e-12)


def test_list_datasets_finds_empty_and_spark_written_ones(spark, tmp_dir):
    from themescope.sources import files as fs
    open(f"{tmp_dir}/empty.csv", "w").close()
    open(f"{tmp_dir}/a.csv", "w").write("id,text\n1,x\n")
    open(f"{tmp_dir}/a_clustered.csv", "w").write("id,text\n1,x\n")
    fs.write_csv(spark.range(3).withColumnRenamed("id", "n"), f"{tmp_dir}/b.csv")
    assert sorted(r.dataset for r in fs.list_datasets(spark, tmp_dir).collect()) == ["a", "b", "empty"]


def test_every_document_is_clustered(spark):
    from themescope import fixtures as fx
    from themescope.plans import catalog as cat
    from tests.conftest import SF_SMALL
    assert fx.clustered(spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    from themescope.operators.ingest import dedup_first
    assert cat.themed_posts(spark, SF_SMALL).count() == dedup_first(fx.posts(spark, SF_SMALL)).count()
