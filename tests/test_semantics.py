"""Hand-computed values and invariants of single operators."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.functions import geodesy as G
from pingframe.functions import geometry as X
from pingframe.functions import scoring as S
from pingframe.operators import conditioning as C
from pingframe.operators import filters as P
from pingframe.operators import physics as PH
from pingframe.operators.evaluation import match_greedy
from pingframe.sinks import reports as R
from pingframe.sources import annotations as A
from pingframe.sources import layers as SL
from pingframe.sources import logs
from pingframe.streaming import live as ST


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_bands_and_priorities(spark):
    rows = spark.createDataFrame([(v,) for v in (100.0, 75.0, 74.9, 50.0, 49.9, 25.0, 0.0)], "s double")
    got = [(r.b, r.p) for r in rows.select(S.severity_band("s").alias("b"), S.priority("s").alias("p")).collect()]
    assert got == [("critical", "HIGH")] * 2 + [("high", "MEDIUM")] * 2 + [("medium", "LOW")] * 2 + [("low", "LOW")]


def test_action_precedence(spark):
    f = lambda *a: one(spark, S.recommend(*[F.lit(x) if x is not None else F.lit(None) for x in a]).alias("r")).r
    assert f("human_body", 99.0, 50.0, "mpa", 10.0).rule == "always_override"
    near = f("ghost_net", 99.0, 50.0, "turtle_zone", 10.0)
    assert near.rule == "near_sensitive_zone" and "Wildlife Warden" in near.action
    assert f("ghost_net", 80.0, 50.0, None, None).rule == "high_severity"
    assert f("ghost_net", 10.0, 80.0, None, None).rule == "deep"
    assert f("container", 10.0, 5.0, None, None).rule == "shallow"
    assert f("container", 10.0, 25.0, None, None).rule == "base"
    assert f("odd", 10.0, None, None, None).requires == "review"


def test_geodesy(spark):
    r = one(spark, G.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("eq"), G.geodesic_m(F.lit(13.0), F.lit(80.0), F.lit(13.0), F.lit(80.0)).alias("zero"),
            G.geodesic_m(F.lit(13.0), F.lit(80.3), F.lit(13.05), F.lit(80.35)).alias("a"), G.short_distance_m(F.lit(13.0), F.lit(80.3), F.lit(13.05), F.lit(80.35)).alias("b"))
    assert abs(r.eq - 111319.4908) < 1e-3 and r.zero == 0.0 and abs(r.a - r.b) < 2e-3
    p = one(spark, G.across_track_position(F.lit(13.0), F.lit(80.3), F.lit(0.0), F.lit("starboard"), F.lit(100.0)).alias("p")).p
    assert p.lon > 80.3 and abs(p.lat - 13.0) < 1e-5


def test_shadow_round_trip_and_multipath(spark):
    r = one(spark, X.shadow_round_trip(F.lit(8.0), F.lit(2.0), F.lit(20.0)).alias("r"), X.is_multipath_candidate(F.lit(13.86), F.lit(8.0)).alias("m"),
            X.is_multipath_candidate(F.lit(13.86), F.lit(None)).alias("u"))
    assert r.r.recovered_height_m == 2.0 and r.r.round_trip_error_m == 0.0 and r.m and r.u is False


def test_unmeasured_never_matches(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, height_m double")
    assert [r.id for r in df.where(~P.dim_filter("height", lo=2.0)).collect()] == ["a", "b"]
    assert df.where(P.dim_filter("height", hi=5.0)).count() == 1


def test_lee_filter_and_equalise_properties(spark):
    rng = np.random.default_rng(0)
    img = rng.rayleigh(10, (40, 30))
    img[:, 0] = np.nan
    rows = [("s", "port", i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(img)]
    g = spark.createDataFrame(rows, "survey string, side string, ping int, cols array<double>")
    n = spark.createDataFrame([("s", "port", 40, 30)], "survey string, side string, n_pings int, n_cols int")
    mat = lambda df: np.array([[np.nan if v is None else v for v in r.cols] for r in df.orderBy("ping").collect()])
    a, b = mat(C.lee_filter(g, n, block=8)), mat(C.lee_filter(g, n, block=64))
    assert np.allclose(a, b, equal_nan=True) and np.isnan(a[:, 0]).all() and np.nanstd(a) < np.nanstd(img)
    e1, e2 = mat(C.equalise(g, n, block=8)), mat(C.equalise(g, n, block=64))
    assert np.allclose(e1, e2, equal_nan=True) and np.nanmin(e1) >= 0 and np.nanmax(e1) <= 1 and np.isnan(e1[:, 0]).all()
    flat = g.select("survey", "side", "ping", F.transform("cols", lambda v: v * 0 + 3.0).alias("cols"))
    assert set(np.unique(mat(C.equalise(flat, n))[:, 1:])) == {0.5}


def test_impulse_median_equals_direct(spark):
    rng = np.random.default_rng(1)
    img = rng.normal(10, 1, (30, 20))
    img[10, 10] = 500.0
    rows = [("s", "port", i, [float(v) for v in r]) for i, r in enumerate(img)]
    g = spark.createDataFrame(rows, "survey string, side string, ping int, cols array<double>")
    n = spark.createDataFrame([("s", "port", 30, 20)], "survey string, side string, n_pings int, n_cols int")
    out = np.array([r.cols for r in C.impulse_median(g, n, block=8).orderBy("ping").collect()])

    def med(m, k):
        p = np.pad(m, k // 2, mode="symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(p, (k, k)).reshape(*m.shape, -1), axis=-1)
    m3 = med(img, 3)
    want = np.where(np.abs(img - m3) > 3 * 1.4826 * med(np.abs(img - m3), 7), m3, img)
    assert np.allclose(out, want) and out[10, 10] < 20
    with pytest.raises(ValueError):
        C.despeckle(g, n, "nope")


def test_dark_run(spark):
    f = lambda row: one(spark, PH.dark_run_end(F.array(*[F.lit(v).cast("double") for v in row]), F.lit(0.5)).alias("e")).e
    assert f([1, 0, 0, 1, 0, 1, 1, 1, 0]) == 4          # two bright columns are bridged, three are not
    assert f([1, 1, 1, 1, 0, 0]) is None                # starts after the lead-in
    assert f([0, 0, None, 0]) == 1                      # no-data ends the run
    assert f([0, 1, 1, 1]) is None                      # one column is no run


def test_greedy_matching_is_one_to_one_in_confidence_order(spark):
    sc = spark.createDataFrame([("c", "d1", 90.0), ("c", "d2", 80.0), ("c", "d3", 70.0)], "config string, det_id string, confidence double")
    cand = spark.createDataFrame([("d1", "t1", 0.5), ("d1", "t2", 0.6), ("d2", "t2", 0.9), ("d2", "t1", 0.4), ("d3", "t1", 0.8)], "det_id string, truth_id string, iou double")
    assert {r.det_id: r.truth_id for r in match_greedy(sc, cand).collect()} == {"d1": "t2", "d2": "t1", "d3": None}


def test_jsf_files(spark, tmp_path):
    def msg(ping, channel, data, weight=0, subsystem=20, kind=80):
        h = bytearray(240)
        struct.pack_into("<i", h, 0, 1700000000 + ping)
        struct.pack_into("<I", h, 8, ping)
        struct.pack_into("<ii", h, 80, int(80.3 * 600000), int(13.0 * 600000))
        struct.pack_into("<h", h, 88, 2)
        struct.pack_into("<H", h, 114, len(data))
        struct.pack_into("<I", h, 116, 20000)
        struct.pack_into("<i", h, 144, 8000)
        struct.pack_into("<f", h, 148, 1500.0)
        struct.pack_into("<h", h, 168, weight)
        body = bytes(h) + np.asarray(data, "<u2").tobytes()
        return struct.pack("<HBBHBBBBHI", 0x1601, 10, 0, kind, 2, subsystem, channel, 0, 0, len(body)) + body
    blob = b"".join([msg(7, 0, [1, 2, 3]), msg(7, 1, [4, 5, 6]), msg(9, 1, [8, 8], 1), msg(9, 1, [7, 7, 7]), msg(9, 0, [1], subsystem=0)]) + msg(11, 0, [1, 2, 3])[:50]
    (tmp_path / "a.jsf").write_bytes(blob)
    (tmp_path / "b.jsf").write_bytes(b"\x00" * 40)
    (tmp_path / "c.xyz").write_bytes(b"?")
    traces, nav, bad = logs.scan_surveys(spark, str(tmp_path))
    t = {(r.side, r.ping): r.samples for r in traces.collect()}
    assert t == {("port", 0): [1, 2, 3], ("starboard", 0): [4, 5, 6], ("port", 1): [0, 0, 0], ("starboard", 1): [7, 7, 7]}
    n = {r.ping: r for r in nav.collect()}
    assert n[0].time == 1700000007 and abs(n[0].lat - 13.0) < 1e-6 and n[0].altitude == 8.0 and abs(n[0].slant_range - 3 * 2e-5 * 750) < 1e-9
    assert {r.error for r in bad.collect()} == {"bad message marker", "unknown format"}


def test_voc_and_layers(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<annotation><object><name> Tyre </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object>"
                                    "<object><name>cube</name><bndbox><xmin>bad</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert [(r.name, r.x1) for r in A.read_voc(spark, str(tmp_path)).collect()] == [("tyre", 30.0)]
    with pytest.raises(ValueError):
        A.require_mapped(spark.createDataFrame([("whale",)], "name string"))
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "N", "kind": "mpa"}, "geometry": {
        "type": "Polygon", "coordinates": [[[80, 13], [81, 13], [81, 14], [80, 13]]]}}]}
    (tmp_path / "mpa.geojson").write_text(json.dumps(doc))
    seg = SL.read_layers(spark, str(tmp_path), {"mpa": 0.5}).collect()
    assert len(seg) == 3 and seg[0].layer == "mpa" and seg[0].weight == 0.5 and seg[0].is_area and seg[0].outer


def test_window_schedule(spark):
    assert one(spark, ST.window_starts(F.lit(300)).alias("w")).w == [0, 160]
    with pytest.raises(ValueError):
        ST.check_window(10, 10)
    p = spark.createDataFrame([(180,), (10,), (299,)], "ping int")
    got = {(r.ping, r.window_start) for r in ST.with_windows(p.withColumn("n", F.lit(300)), n_pings="n").collect()}
    assert got == {(180, 0), (180, 160), (10, 0), (299, 160)}


def test_report_columns():
    assert len(R.CSV_COLUMNS) == 24
