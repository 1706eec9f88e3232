"""Tours give one complete answer: dense order, every leg, and no change with the size of a task."""

import numpy as np
from pyspark.sql import functions as F

from pingframe.operators.clusters import _arc, _ecef_np, cluster_tours, tour, zone_tours


def stops_of(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i:03d}", "s", f"z{int(z)}", 13 + float(a), 80 + float(b), float(v))
            for i, (z, a, b, v) in enumerate(zip(rng.integers(0, 9, n), rng.random(n) / 100, rng.random(n) / 100, rng.random(n)))]
    return spark.createDataFrame(rows + [("lone", "s", "z99", 13.02, 80.02, 0.5)], "id string, survey string, zone string, lat double, lon double, severity double")


def check_legs(rows, start=None):
    rows = sorted(rows, key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    at = ([start] if start else []) + [(r.lat, r.lon) for r in rows]
    p = _ecef_np(np.array([x[0] for x in at]), np.array([x[1] for x in at]))
    want = _arc(np.linalg.norm(np.diff(p, axis=0), axis=1))
    got = [r.leg_m for r in rows]
    if not start:
        assert got.pop(0) is None
    assert np.allclose(got, want, atol=1e-3)


def test_strips_are_stitched(spark):
    c = stops_of(spark, 40)
    for start in (None, (13.0, 80.0)):
        for stops in (4, 5000):
            rows = zone_tours(c, ("survey",), start, stops).collect()
            assert {r.id for r in rows} == {r.id for r in c.collect()}
            check_legs(rows, start)


def test_one_strip_is_the_plain_tour(spark):
    c = stops_of(spark, 30)
    plain = c.orderBy(F.desc("severity"), "id").collect()
    order = tour(np.array([r.lat for r in plain]), np.array([r.lon for r in plain]))
    assert [r.id for r in zone_tours(c, ("survey",)).orderBy("seq").collect()] == [plain[i].id for i in order]


def test_two_level_tour_is_the_same_for_every_task_limit(spark):
    c = stops_of(spark, 40)
    labels = c.select("id", "survey", "zone")
    for stops, start, limits in ((3, (13.0, 80.0), (3, 7, 5000)), (5000, None, (5000,))):
        answers = []
        for limit in limits:
            rows = cluster_tours(c.drop("zone"), labels, start, stops, limit).collect()
            check_legs(rows, start)
            answers.append(sorted((r.seq, r.zone_seq, r.id, round(r.leg_m or 0, 3)) for r in rows))
        assert all(x == answers[0] for x in answers) and len(answers[0]) == 41
        zone_order = [z for _, z, *_ in answers[0]]
        assert zone_order == sorted(zone_order)
