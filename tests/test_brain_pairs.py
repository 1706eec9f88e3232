"""Brains meet by distinct boxes, and only equal boxes are compared at an overlap of 1."""
from pingframe.operators import detections as D

SCHEMA = "det_id string, survey string, side string, ping0 int, ping1 int, col0 int, col1 int, cls string, score double, brain string"


def boxes(spark, brain, n, p=0):
    return spark.createDataFrame([(f"{brain}{i:02d}", "s", "port", p, p + 9, 0, 9, "tire", 0.5, brain) for i in range(n)], SCHEMA)


def test_copies_meet_once(spark, monkeypatch):
    seen, pairs = [], D.box_pairs
    monkeypatch.setattr(D, "box_pairs", lambda *a, **k: seen.append(pairs(*a, **k)) or seen[-1])
    out = D.merge_brains(boxes(spark, "A", 6), boxes(spark, "C", 5), boxes(spark, "B", 3, 1)).collect()
    assert {r.brain for r in out} == {"ABC"} and len(out) == 6
    assert {round(r.score, 6) for r in out} == {0.7}
    assert max(df.count() for df in seen) == 1


def test_overlap_of_one_is_an_equality(spark):
    from pingframe.operators.joins import box_pairs
    a, c = boxes(spark, "A", 2), boxes(spark, "C", 1).unionByName(boxes(spark, "B", 1, 1))
    p = box_pairs(a, c, ["survey", "side"], 1.0)
    assert sorted((r.l_det_id, r.r_det_id, r.iou) for r in p.collect()) == [("A00", "C00", 1.0), ("A01", "C00", 1.0)]
    assert "_bp" not in p._jdf.queryExecution().toString()
