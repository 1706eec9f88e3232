"""The radix search for percentiles shuffles no numbers when the wanted ranks are few."""

from pyspark.sql import functions as F

from pingframe.operators import scale as S


def test_few_ranks_are_broadcast(spark, monkeypatch):
    t = spark.range(600).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101) - 50.5).alias("v"))
    want = sorted(t.groupBy("k").agg(F.percentile("v", F.lit(0.25)).alias("q"), F.percentile("v", F.lit(0.9)).alias("r")).collect())
    joins, salted = [], S.salted_join
    monkeypatch.setattr(S, "salted_join", lambda *a, **k: joins.append(1) or salted(*a, **k))
    search = lambda: sorted(S.exact_percentiles(t, ["k"], "v", {"q": 0.25, "r": 0.9}, max_group=10).collect())
    assert search() == want and not joins
    monkeypatch.setattr(S, "SMALL_ROWS", 0)
    assert search() == want and len(joins) == 4
