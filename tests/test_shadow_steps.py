from pyspark.sql import functions as F

from pingframe.operators import physics as PH


def test_medians_equal_percentiles_and_rows_are_cropped_once(spark, monkeypatch):
    rows = [(d, r, 2, [None if (d + r + c) % 5 == 0 else float((d * 31 + r * 17 + c * 7) % 23) for c in range(20)]) for d in range(40) for r in range(d % 4 + 1)]
    rows.append((99, 0, 2, [None] * 20))
    crop = spark.createDataFrame(rows, "det_id long, row int, lo_col int, cols array<double>").withColumns(
        {k: F.lit(v) for k, v in {"near_lo": 0, "near_hi": 6, "far_lo": 14, "far_hi": 54, "col0": 8, "col1": 11}.items()})
    got = {r.det_id: (r.background, r.box_median) for r in PH.backgrounds(crop).collect()}
    px = PH._pixels(crop)
    med = lambda a, b: F.percentile(F.when(F.col("col").between(a, b), F.col("v")), F.lit(0.5))
    want = {r.det_id: (r.n if (r.n or 0) > 0 else r.f if (r.f or 0) > 0 else None, r.b) for r in px.groupBy("det_id").agg(med(0, 5).alias("n"), med(14, 53).alias("f"), med(8, 11).alias("b")).collect()}
    assert got == want and got[99] == (None, None)

    calls, crop_rows = [], PH.crop_rows
    monkeypatch.setattr(PH, "crop_rows", lambda *a, **k: calls.append(1) or crop_rows(*a, **k))
    ground = spark.createDataFrame([("S", "port", p, [float((p * 7 + c * 3) % 11 + 1) for c in range(60)]) for p in range(12)], "survey string, side string, ping int, cols array<double>")
    dets = spark.createDataFrame([("a", "S", "port", 2, 6, 20, 24, "tire", 0.5)], "det_id string, survey string, side string, ping0 int, ping1 int, col0 int, col1 int, cls string, score double")
    altitude = spark.createDataFrame([("S", p, 8.0) for p in range(12)], "survey string, ping int, altitude_m double")
    grid = spark.createDataFrame([("S", "port", 12, 60, 0.5)], "survey string, side string, n_pings int, n_cols int, ground_res double")
    assert PH.features(dets, ground, altitude, grid).count() == 1 and len(calls) == 2
