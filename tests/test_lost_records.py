"""Records that one side of a survey has lost: the image keeps its pings."""

from pyspark.sql import functions as F

from pingframe.operators import conditioning as C
from pingframe.operators import physics as PH
from pingframe.sources import logs


def test_a_lost_record_does_not_shorten_the_image_of_its_side(spark):
    grid = spark.createDataFrame([("s", "port", 10, 8, 0.5), ("s", "starboard", 9, 8, 0.5)], "survey string, side string, n_pings long, n_cols int, ground_res double")
    dets = spark.createDataFrame([("a", "s", "starboard", 9, 14, 1, 3), ("b", "s", "port", 7, 14, 1, 30)], "det_id string, survey string, side string, ping0 int, ping1 int, col0 int, col1 int")
    got = {r.det_id: (r.ping0, r.ping1, r.col0, r.col1) for r in PH.clip_boxes(dets, grid).collect()}
    assert got == {"a": (9, 9, 1, 3), "b": (7, 9, 1, 7)}


def test_a_lost_record_is_a_ground_line_without_data(spark):
    side = "survey string, side string, ping int, "
    traces = spark.createDataFrame([("s", "port", 0, [1.0] * 8), ("s", "port", 1, [1.0] * 8), ("s", "starboard", 0, [1.0] * 8)], side + "samples array<double>")
    first = traces.select("survey", "side", "ping", F.lit(1).alias("first_return"))
    bottom = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 1.0)], "survey string, ping int, altitude_m double")
    geom = spark.createDataFrame([("s", "port", 2, 8, 1.0), ("s", "starboard", 1, 8, 1.0)], "survey string, side string, n_pings long, n_samples int, slant_res double")
    grid = C.ground_grid(geom, bottom)
    assert {r.n_pings for r in grid.collect()} == {2}
    got = {(r.side, r.ping): r.cols for r in C.slant_to_ground(traces, first, bottom, grid).collect()}
    assert sorted(got) == [("port", 0), ("port", 1), ("starboard", 0), ("starboard", 1)]
    assert set(got["starboard", 1]) == {None} and len(got["starboard", 1]) == len(got["port", 1]) and 1.0 in got["port", 1]


def test_a_ping_that_lost_both_sides_stays(spark):
    rows = [("s", 0, "port", [3.0, 4.0]), ("s", 1, "port", None), ("s", 1, "starboard", [1.0, 2.0]), ("s", 2, "port", None)]
    got = {r.ping: (r.port, r.starboard) for r in logs.pair_sides(spark.createDataFrame(rows, "survey string, ping int, side string, samples array<double>")).collect()}
    assert got == {0: ([3.0, 4.0], [0.0, 0.0]), 1: ([0.0, 0.0], [1.0, 2.0]), 2: ([], [])}
