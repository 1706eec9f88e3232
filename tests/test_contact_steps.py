"""Contact queries that look once, and curves worked out by compiled code."""

from pyspark.sql import functions as F

from checks import load_all
from checks.registry import QUERIES
from pingframe.functions import geometry as X
from pingframe.operators import clusters as C
from pingframe.operators import joins as J

load_all()


def test_resolution_rows_are_the_curve(spark):
    t = spark.createDataFrame([(1, 8.0, 50.0), (2, None, 30.0), (3, 9.0, 4.0), (4, -1.0, 20.0), (5, 3.0, None)], "k int, a double, s double")
    want = t.select("k", F.inline(X.resolution_curve("a", "s", 6))).collect()
    assert sorted(X.resolution_rows(t, "a", "s", 6).drop("a", "s").collect()) == sorted(want) and len(want) == 35


def test_the_query_has_no_lambda(spark):
    plan = QUERIES["x5_resolution_curve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "Generate explode" in plan


def test_a_diff_searches_once(spark, monkeypatch):
    calls, near = [], J.nearest_within
    for m in (J, C):
        monkeypatch.setattr(m, "nearest_within", lambda *a, **k: calls.append(1) or near(*a, **k))
    rows = QUERIES["j12_survey_diff"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len(calls) == 1
