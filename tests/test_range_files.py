"""Ranges of large groups are kept as columnar files, not as checkpoints of rows."""
from pyspark.sql import functions as F

from pingframe.operators import scale as S


def test_ranges_of_large_groups_are_written_as_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "cut_lineage", None)
    t = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    sums = S.running_sums(t, ["k"], [F.desc("o")], {"s": "v"}, max_group=20)
    assert {(r.o, r.s) for r in sums.collect()} == {(o, (299 - o) // 2 + 1) for o in range(300)}
    assert {(r.o, r.rank) for r in S.ranked(t, ["k"], [F.asc("o")], max_group=20).collect()} == {(o, o // 2 + 1) for o in range(300)}
