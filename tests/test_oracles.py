"""Every registered query with an SQL oracle equals DuckDB on sf0.001."""

import pytest

import __spark_entry__ as E
from tests.compare import spark_vs_duck
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
SLOW = {"kmeans_fit", "elbow_curve"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    (sc, sr), (dc, dr) = spark_vs_duck(df, duck, ORACLES[name])
    assert sc == dc
    assert sum(sr.values()) == sum(dr.values())
    assert sr == dr


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES) - SLOW))
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cluster", "label", "n_posts", "pct", "sample", "line"]
    assert df.count() > 0


PLAN_SKIP = SLOW | {"layout_2d", "stream_ingest", "stream_assign", "stream_drift", "stream_centres"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - PLAN_SKIP))
def test_no_cross_join_in_plan(spark, name):
    """No registered query pairs rows by a cartesian product or nested loop."""
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
