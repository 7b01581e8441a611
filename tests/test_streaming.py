"""Streaming = batch on the same files; late and duplicate rows."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from themescope import streaming as st
from themescope.operators import cluster as cl
from themescope.operators import drift as dr

LONG = "a post body that is clearly longer than forty characters in total"


def page(ct, p, hits):
    return json.dumps({"content_type": ct, "page": p, "hits": hits})


def h(oid, ts, text=LONG):
    return {"objectID": oid, "comment_text": text, "created_at_i": ts, "points": 1}


def test_stream_dedup_keeps_old_and_untimed_posts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    day = 86400
    t0 = 1_704_067_200                                     # 2024-01-01
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(page("comment", 0, [h("1", t0), h("2", t0 + 10 * day)]) + "\n")
    q_out, q_chk = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "chk")
    posts = st.dedup_stream(st.ingest_stream(spark, src), "1 day")
    st.run_available_now(posts.select("id", "created_at"), q_out, q_chk)
    # second run on the same checkpoint: a duplicate id, an old post and one without a time
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(page("comment", 1, [h("2", t0 + 10 * day), h("3", t0 + 1 * day), h("4", None)]) + "\n")
    st.run_available_now(st.dedup_stream(st.ingest_stream(spark, src), "1 day").select("id", "created_at"),
                         q_out, q_chk)
    ids = sorted(r.id for r in spark.read.parquet(q_out).collect())
    assert ids == ["1", "2", "3", "4"]                     # "2" once; only the landing time can be late


def test_stream_drift_equals_batch(spark, tmp_dir):
    rows = [(str(i), dt.datetime(2024, 1, 1 + (i * 7) % 28, 12), i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id STRING, created_at TIMESTAMP, cluster INT, ord BIGINT")
    st.write_stream_input(df, os.path.join(tmp_dir, "in"), 4)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(tmp_dir, "in"))
    from themescope.streaming.jobs import latest_updates, run_updates
    run_updates(st.drift_counts_stream(s, "7 days", delay="40 days"), os.path.join(tmp_dir, "out"),
                os.path.join(tmp_dir, "chk"))
    got = {(r.period_start, r.cluster, r.n_posts) for r in
           latest_updates(spark, os.path.join(tmp_dir, "out"), ["period_start", "cluster"]).collect()}
    want = {(r.period_start, r.cluster, r.n_posts) for r in dr.drift_timeline(df).collect()}
    assert got == want


def test_stream_sliding_drift_equals_batch(spark, tmp_dir):
    rows = [(str(i), dt.datetime(2024, 1, 1 + (i * 5) % 28, i % 24), i % 4, i) for i in range(80)]
    df = spark.createDataFrame(rows, "id STRING, created_at TIMESTAMP, cluster INT, ord BIGINT")
    st.write_stream_input(df, os.path.join(tmp_dir, "in"), 3)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(tmp_dir, "in"))
    from themescope.streaming.jobs import latest_updates, run_updates
    run_updates(st.drift_counts_stream(s, "7 days", slide="2 days", delay="40 days"),
                os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "chk"))
    got = {(r.period_start, r.cluster, r.n_posts) for r in
           latest_updates(spark, os.path.join(tmp_dir, "out"), ["period_start", "cluster"]).collect()}
    w = F.window("created_at", "7 days", "2 days")
    want = {(r.s, r.cluster, r.n) for r in df.groupBy(w.start.alias("s"), "cluster")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
    # every row is counted in size/slide overlapping windows (7/2 → 3 or 4)
    assert 3 * len(rows) <= sum(n for _, _, n in got) <= 4 * len(rows)


def test_stream_assignment_equals_batch(spark, tmp_dir):
    rows = [(str(i), [float(i % 5), float(i % 7), 1.0], i) for i in range(40)]
    df = spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, ord BIGINT")
    centres = cl.centres_literal([{"cluster": 0, "center": [1.0, 0.0, 0.0]},
                                  {"cluster": 1, "center": [0.0, 1.0, 0.0]},
                                  {"cluster": 2, "center": [0.0, 0.0, 1.0]}])
    st.write_stream_input(df, os.path.join(tmp_dir, "in"), 3)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(tmp_dir, "in"))
    st.run_available_now(st.assign_stream(s, centres).select("id", "cluster"), os.path.join(tmp_dir, "out"),
                         os.path.join(tmp_dir, "chk"))
    got = {(r.id, r.cluster) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    want = {(r.id, r.cluster) for r in cl.assign_nearest(df, centres).collect()}
    assert got == want


def test_centre_update_replay_is_idempotent(spark, tmp_dir):
    cpath = os.path.join(tmp_dir, "centres")
    spark.createDataFrame([(0, [1.0, 0.0], 2.0), (1, [0.0, 1.0], 2.0)],
                          "cluster INT, center ARRAY<DOUBLE>, weight DOUBLE").write.parquet(f"{cpath}/version=-1")
    batch = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "id STRING, embedding ARRAY<DOUBLE>")
    fn = st.update_centres_batch(cpath, decay=0.5)
    fn(batch, 0)
    first = sorted((r.cluster, tuple(r.center), r.weight) for r in
                   spark.read.parquet(cpath).where("version = 0").collect())
    fn(batch, 0)                                           # replay of the same batch id
    again = sorted((r.cluster, tuple(r.center), r.weight) for r in
                   spark.read.parquet(cpath).where("version = 0").collect())
    assert first == again
    c0 = [c for c in first if c[0] == 0][0]
    assert abs(c0[2] - 2.0) < 1e-12                        # 2·0.5 + 1 member
    assert abs(c0[1][0] - 1.0) < 1e-12


def land(spark, rows, schema, path, n):
    """Rows in ``n`` files, file by file in the order given."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step:(k + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_keep_first_stream_equals_batch(spark, tmp_dir):
    from themescope.operators.ingest import dedup_first
    rng = random.Random(3)
    t = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)
    rows = [(None if i % 3 == 0 else str(rng.randrange(40)), i, rng.choice([None, i]), f'post "{i}"\n', rng.choice([None, t]), t)
            for i in range(300)]                           # a third of the rows without id
    rng.shuffle(rows)
    schema = "id STRING, ord BIGINT, score BIGINT, text STRING, created_at TIMESTAMP, landed_at TIMESTAMP"
    posts = st.keep_first_stream(land(spark, rows, schema, f"{tmp_dir}/in", 5), "1 day")
    st.run_updates(posts, f"{tmp_dir}/out", f"{tmp_dir}/chk")
    got = st.kept_first(spark, f"{tmp_dir}/out", posts.schema)
    want = dedup_first(spark.createDataFrame(rows, schema).drop("landed_at"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_keep_first_state_is_dropped_after_its_time(spark, tmp_dir):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [("a", 5, day(1)), ("b", 6, day(2)), ("c", 7, day(9)), ("d", 8, day(10)), ("a", 4, day(11)), ("b", 9, day(12))]
    posts = st.keep_first_stream(land(spark, rows, "id STRING, ord BIGINT, landed_at TIMESTAMP", f"{tmp_dir}/in", 6), "2 days")
    st.run_updates(posts, f"{tmp_dir}/out", f"{tmp_dir}/chk")
    sent = spark.read.schema(posts.schema).parquet(f"{tmp_dir}/out/batch_id=*").collect()
    assert sorted((r.id, r.ord) for r in sent) == [("a", 4), ("a", 5), ("b", 6), ("b", 9), ("c", 7), ("d", 8)]   # b known no more: sent again
    assert sorted((r.id, r.ord) for r in st.kept_first(spark, f"{tmp_dir}/out", posts.schema).collect()) == [("a", 4), ("b", 6), ("c", 7), ("d", 8)]


def test_late_rows_are_kept_and_counted(spark, tmp_dir):
    rng = random.Random(4)
    rows = [(str(i), dt.datetime(2024, 1, 1, 6) + dt.timedelta(days=rng.randrange(150)), i % 3) for i in range(240)]   # five months, no order
    rows += [("none", None, 1)]
    s = land(spark, rows, "id STRING, created_at TIMESTAMP, cluster INT", f"{tmp_dir}/in", 6)
    fn = st.drift_with_late_batch(spark, f"{tmp_dir}/out", "7 days", "7 days")
    st.run_batches(s, fn, f"{tmp_dir}/chk")
    batch = spark.createDataFrame(rows, "id STRING, created_at TIMESTAMP, cluster INT")
    w = F.window("created_at", "7 days")
    want = {(r.s, r.cluster, r.n) for r in batch.groupBy(w.start.alias("s"), "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    corrected = lambda: {tuple(r) for r in st.drift_counts_corrected(spark, f"{tmp_dir}/out").collect()}
    assert corrected() == want
    late = st.late_rows(spark, f"{tmp_dir}/out")
    on_time = st.drift_counts_on_time(spark, f"{tmp_dir}/out").agg(F.sum("n_posts")).first()[0]
    assert late.count() + on_time == len(rows) and on_time < 240
    assert [r.id for r in late.where("period_start IS NULL").collect()] == ["none"]
    # Plain rule: a row is late when its period ended by the latest time of earlier files less a week.
    plain, latest = set(), None
    for k in range(6):
        part = rows[k * 41:(k + 1) * 41]
        for i, t, _ in part:
            end = t and dt.datetime(1970, 1, 1) + dt.timedelta(days=((t - dt.datetime(1970, 1, 1)).days // 7 + 1) * 7)
            if t is None or (latest and end <= latest - dt.timedelta(days=7)):
                plain.add(i)
        latest = max([latest or dt.datetime.min, *[t for _, t, _ in part if t]])
    assert {r.id for r in late.collect()} == plain
    fn(batch.limit(0), 99)                                 # an empty batch, and a replay of it
    fn(batch.limit(0), 99)
    assert corrected() == want
