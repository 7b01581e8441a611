"""What a task reads or holds does not grow with the table."""

from themescope import streaming as st
from themescope.operators import encode as en
from themescope.operators import ingest as ing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_not_dealt_by_tag(spark):
    hits = spark.createDataFrame([("story", 0, "a" * 100), ("story", 2, "b"), ("comment", 0, "c")], "content_type string, page int, title string")
    got = ing.pages_before_stop(hits)
    assert sorted((r.content_type, r.page) for r in got.collect()) == [("comment", 0), ("story", 0)]
    assert "rightHint=(strategy=broadcast)" in got._jdf.queryExecution().optimizedPlan().toString()


def test_term_counts_are_dealt_by_size_of_text(spark, monkeypatch):
    monkeypatch.setattr(en, "PART_TEXT_BYTES", 100)
    df = spark.createDataFrame([(i, "one two three " * 20) for i in range(30)] + [(None, "four"), (None, "four")], "doc_id long, text string")
    parts = -(-(30 * 280 + 8) // 100)
    counts = en.hashed_term_counts(df)
    assert "hashpartitioning(id#" in plan(counts) and f", {parts})" in plan(counts) and "bucket" not in "".join(
        x for x in plan(counts).splitlines() if "hashpartitioning" in x)
    got = {r.doc_id: (r.n_terms, r.top_count) for r in counts.collect()}
    assert got[0] == (60, 20) and got[None] == (2, 2) and len(got) == 31


def test_landed_files_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(st.jobs, "LANDED_FILE_BYTES", 1000)
    df = spark.createDataFrame([("x" * 500,)] * 20, "text string")
    assert st.landed_files(df, 4) == 12 and st.landed_files(df.limit(0), 4) == 4
