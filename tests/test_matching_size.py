"""Matching of many copies: equal boxes meet once, and rounds keep slim files."""

from pyspark.sql import functions as F

from pingframe.operators import evaluation as E

DETS = "survey string, side string, cls string, ping0 int, ping1 int, col0 int, col1 int"


def copies(spark, name, n):
    here = spark.createDataFrame([("s", "port", "x", 0, 9, 0, 9)], DETS)
    return here.crossJoin(spark.range(n).select(F.concat(F.lit(name), F.col("id").cast("string")).alias(f"{name}_id")))


def test_copies_are_met_once(spark, monkeypatch):
    d, t = copies(spark, "det", 5000), copies(spark, "truth", 5000)
    far = spark.createDataFrame([("s", "port", "x", 50, 59, 0, 9, "lonely"), ("s", "port", "x", 0, 9, 0, 9, None)], DETS + ", det_id string")
    seen, pairs = [], E.box_pairs
    monkeypatch.setattr(E, "box_pairs", lambda *a, **k: seen.append(pairs(*a, **k)) or seen[-1])
    got = E.any_match(d.unionByName(far), t)
    assert got.columns[0] == "det_id"
    assert {(r.det_id, r.correct) for r in got.where("NOT correct").collect()} == {("lonely", False), (None, False)}
    assert got.where("correct").count() == 5000 and [p.count() for p in seen] == [1]


def test_rounds_write_each_id_once(spark, monkeypatch):
    cut, files = [], []
    checkpoint, write = E.cut_lineage, getattr(E, "written", None)
    monkeypatch.setattr(E, "cut_lineage", lambda df: cut.append(df.columns) or checkpoint(df))
    if write:
        monkeypatch.setattr(E, "written", lambda df: files.append(df.columns) or write(df))
    sc = spark.createDataFrame([("c", f"d{i}", 90.0 - i % 3) for i in range(9)], "config string, det_id string, confidence double")
    cand = spark.createDataFrame([(f"d{i}", f"t{j}", 0.3 + (i * 5 + j) % 7 / 10) for i in range(9) for j in range(4)], "det_id string, truth_id string, iou double")
    free, want = {f"t{j}" for j in range(4)}, {}
    for i in sorted(range(9), key=lambda i: (i % 3 - 90.0, f"d{i}")):
        best = min(((-(0.3 + (i * 5 + j) % 7 / 10), f"t{j}") for j in range(4) if f"t{j}" in free), default=None)
        want[f"d{i}"] = best and best[1]
        free.discard(want[f"d{i}"])
    assert {r.det_id: r.truth_id for r in E.match_greedy(sc, cand).collect()} == want
    assert all(c == ["config", "det_id", "truth_id"] for c in cut)
    assert files and all(sorted(c) == ["confidence", "config", "det_id", "iou", "truth_id"] for c in files)
