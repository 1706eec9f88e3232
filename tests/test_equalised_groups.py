"""Contrast equalisation: curves go to pings between the same rows of cells, however small the blocks."""

from pyspark.sql import functions as F

from pingframe.operators import conditioning as C


def test_small_blocks_share_curves(spark, monkeypatch):
    v = F.when((F.col("ping") * 7 + F.col("j")) % 13 > 0, (F.col("ping") * 31 + F.col("j") * 17) % 101 + 0.5)
    lines = spark.range(180).select(F.lit("s").alias("survey"), F.lit("port").alias("side"), F.col("id").cast("int").alias("ping"))
    ground = lines.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(23)))).groupBy("survey", "side", "ping").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", v.alias("v")))), lambda e: e["v"]).alias("cols"))
    flat = lines.withColumn("side", F.lit("flat")).withColumn("cols", F.array(F.lit(3.0), F.lit(None).cast("double"), F.lit(3.0)))
    image = ground.unionByName(flat)
    shape = spark.createDataFrame([("s", "port", 180), ("s", "flat", 180)], "survey string, side string, n_pings int")
    out = C.equalise(image, shape, block=16)
    assert "_y" in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[1].split("\n")[0]
    got = {(r.side, r.ping): r.cols for r in out.collect()}
    assert len(got) == 360 and got["flat", 7] == [0.5, None, 0.5]
    holes = {(r.side, r.ping): [x is None for x in r.cols] for r in image.collect()}
    assert holes == {k: [x is None for x in c] for k, c in got.items()}
    assert all(0.0 <= x <= 1.0 for c in got.values() for x in c if x is not None)
    monkeypatch.setattr(C, "PIXELS", 24)
    small = C.equalise(image, shape, block=1)                       # a group for every ping
    assert {(r.side, r.ping): r.cols for r in small.collect()} == got
