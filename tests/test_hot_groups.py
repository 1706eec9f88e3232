"""The routes for hot groups give the same answers as brute force, with limits forced down."""

import random

import numpy as np
from pyspark.sql import functions as F

from pingframe.functions.geodesy import short_distance_m
from pingframe.operators import clusters as C
from pingframe.operators import detections as D
from pingframe.operators import joins as J
from pingframe.operators import layers as L
from pingframe.operators.components import connected_components
from pingframe.operators.scale import exact_percentiles, interpolate_gaps, ranked, running_sums


def test_ranked_and_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "cold", rng.randint(0, 20), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {(r.k, r.i): (r["rank"], r.cum) for r in running_sums(
        ranked(df, ["k"], [F.desc("v"), F.asc("i")], max_group=50), ["k"], [F.desc("v"), F.asc("i")], {"cum": "v"}, max_group=50).collect()}
    for key in ("hot", "cold"):
        total = 0
        for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            total += v
            assert got[(key, i)] == (n, total)


def test_bracketed_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    vals = np.r_[rng.normal(size=900), np.full(300, 0.25), [1e12]]
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    out = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"med": 0.5, "hi": 0.97}, max_group=40).collect()}
    assert abs(out["a"].med - np.percentile(vals, 50)) < 1e-12 and abs(out["a"].hi - np.percentile(vals, 97)) < 1e-9
    assert out["b"].med == 1.5


def _boxes(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p, c = rng.randint(0, 60), rng.randint(0, 60)
        if i % 3 == 0:
            p, c = 20 + rng.randint(0, 2), 20 + rng.randint(0, 2)          # a crowd of near copies
        rows.append((f"d{i:04d}", "s", "port", "tire", p, p + rng.randint(3, 14), c, c + rng.randint(3, 14), rng.randint(0, 50) / 50))
    return rows


def _iou(a, b):
    h, w = min(a[5], b[5]) - max(a[4], b[4]) + 1, min(a[7], b[7]) - max(a[6], b[6]) + 1
    if h <= 0 or w <= 0:
        return 0.0
    area = lambda x: (x[5] - x[4] + 1) * (x[7] - x[6] + 1)
    return h * w / (area(a) + area(b) - h * w)


def test_suppression_by_pairs_and_by_cells_equal_greedy(spark):
    rows = _boxes(240, 3)
    df = spark.createDataFrame(rows, "det_id string, survey string, side string, cls string, ping0 int, ping1 int, col0 int, col1 int, score double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[8], r[0])):
        if all(_iou(r, k) < 0.4 for k in kept):
            kept.append(r)
    want = {r[0] for r in kept}
    keys = ["survey", "side", "cls"]
    for budget in (1e9, 0):
        assert {r.det_id for r in D.greedy_keep(df, keys, 0.4, budget=budget).collect()} == want


def test_fused_ensemble(spark):
    rows = [("a", 0, 10, 29, 20, 39, 0.9), ("b", 1, 10, 29, 20, 39, 0.8), ("c", 2, 10, 29, 20, 39, 0.7), ("x", 1, 200, 209, 5, 9, 0.9)]
    df = spark.createDataFrame([(i, "s", "port", "tire", m, *b, sc) for i, m, *b, sc in rows],
                               "det_id string, survey string, side string, cls string, model int, ping0 int, ping1 int, col0 int, col1 int, score double")
    out = {r.det_id: r for r in D.fuse_ensemble(df, 3).collect()}
    assert set(out) == {"a", "x"} and abs(out["a"].score - 0.8) < 1e-9 and abs(out["x"].score - 0.3) < 1e-9
    assert {r.det_id for r in D.fuse_ensemble(df, 3, min_models=2).collect()} == {"a"}


def _points(n, seed, p):
    rng = random.Random(seed)
    return [(f"{p}{i:03d}", "s", 13.0 + rng.randint(0, 120) * 5e-6, 80.3 + rng.randint(0, 120) * 5e-6, float(rng.randint(0, 99))) for i in range(n)]


def test_nearest_by_cells_and_by_pyramid(spark):
    a = spark.createDataFrame(_points(60, 4, "a"), "id string, survey string, lat double, lon double, severity double")
    b = spark.createDataFrame(_points(90, 5, "b"), "id string, survey string, lat double, lon double, severity double")
    cross = b.alias("b").join(a.alias("a"), F.col("a.survey") == F.col("b.survey")).select(
        F.col("b.id").alias("id"), F.col("a.id").alias("aid"), short_distance_m("b.lat", "b.lon", "a.lat", "a.lon").alias("d")).where("d <= 12")
    want = {r.id: (round(r.m.d, 6), r.m.aid) for r in cross.groupBy("id").agg(F.min(F.struct("d", "aid")).alias("m")).collect()}
    for fn in (J.nearest_within, J.pyramid_nearest):
        got = {r.id: (round(r.distance_m, 6), r.near_id) for r in fn(b, a, 12.0, "id", "id").collect()}
        assert got == want


def test_linkage_zones_equal_union_find(spark):
    pts = _points(120, 6, "p") + [("q1", "s", 13.0, 80.3, 1.0), ("q2", "s", 13.0, 80.3, 1.0)]
    df = spark.createDataFrame(pts, "id string, survey string, lat double, lon double, severity double")
    d = {(r.a, r.b) for r in df.alias("x").join(df.alias("y"), F.col("x.survey") == F.col("y.survey")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), short_distance_m("x.lat", "x.lon", "y.lat", "y.lon").alias("d")).where("d <= 6").collect()}
    parent = {p[0]: p[0] for p in pts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in d:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got = {r.id: r.zone for r in C.linkage_labels(df, 6.0).collect()}
    assert got == {p[0]: find(p[0]) for p in pts}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = e.selectExpr("src AS node").union(e.selectExpr("dst")).distinct()
    assert {r.label for r in connected_components(nodes, e).collect()} == {0, 1000}


def test_layers_small_and_bucketed_agree(spark):
    pts = spark.createDataFrame([(f"c{i}", 13.0 + i * 0.004, 80.3 + (i % 4) * 0.01) for i in range(20)], "id string, lat double, lon double")
    ring = [(80.305, 13.01), (80.318, 13.012), (80.315, 13.03), (80.304, 13.028)]
    seg = []
    for f, (w, shift) in enumerate([(1.0, 0.0), (0.6, 0.05)]):
        for k in range(4):
            (x0, y0), (x1, y1) = ring[k], ring[(k + 1) % 4]
            seg.append((f"L{f}", f, f"n{f}", "mpa", w, f, True, True, x0, y0 + shift, x1, y1 + shift))
    s = spark.createDataFrame(seg, "layer string, feature int, name string, kind string, weight double, ord int, is_area boolean, outer boolean, x0 double, y0 double, x1 double, y1 double")
    rows = lambda limit: {r.id: (r.nearest_layer, r.nearest_layer_distance_m, round(r.proximity, 9)) for r in L.nearest_layer(pts, s, limit=limit).collect()}
    assert rows(100) == rows(2)


def test_gap_filling_across_blocks(spark):
    v = [None, None, 2.0, None, None, None, 8.0] + [None] * 9
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "survey string, ping int, v double")
    got = [r.f for r in interpolate_gaps(df, ["survey"], "ping", "v", "f", block=4).orderBy("ping").collect()]
    at = [i for i, x in enumerate(v) if x is not None]
    assert np.allclose(got, np.interp(np.arange(len(v)), at, [v[i] for i in at]))


def test_cross_view_pairs_equal_sorted_greedy(spark):
    rng = random.Random(8)
    pairs = [(f"a{rng.randint(0, 25)}", f"b{rng.randint(0, 25)}", rng.randint(0, 30) / 2) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a_id string, b_id string, distance_m double")
    used, want = set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, d))
    assert {(r.a_id, r.b_id, r.distance_m) for r in C.greedy_nearest_pairs(df).collect()} == want
