"""Pairs of overlapping boxes: copies meet once and are paired by id where they met."""
import random

import pytest

from pingframe.operators import evaluation as E
from pingframe.operators import joins as J

from .test_fusion import SCHEMA, boxes, overlap

KEYS = ["survey", "side", "cls"]


@pytest.mark.parametrize("chunk", [1000, 3])
@pytest.mark.parametrize("min_iou", [0.25, 0.6, 1.0])
def test_own_pairs_are_all_pairs(spark, monkeypatch, chunk, min_iou):
    monkeypatch.setattr(J, "PLACE_IDS", chunk)
    rows = boxes(200)
    rows += [{**rows[0], "det_id": f"z{k}"} for k in range(25)]
    random.Random(1).shuffle(rows)
    rows.append(dict(rows[5]))                                     # the same row twice: both pair with the others
    want = sorted((a["det_id"], b["det_id"], round(overlap(a, b), 9)) for a in rows for b in rows if a["det_id"] < b["det_id"]
                  and (a["survey"], a["cls"]) == (b["survey"], b["cls"]) and overlap(a, b) >= min_iou)
    got = J.own_place_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), KEYS, min_iou, "det_id").collect()
    assert sorted((r.l_id, r.r_id, round(r.iou, 9)) for r in got) == want


def test_copies_meet_once(spark, monkeypatch):
    rows = boxes(1)
    t = spark.createDataFrame([{**rows[0], "det_id": f"d{k}"} for k in range(300)], SCHEMA)
    seen, pairs = [], J.box_pairs
    for m in (J, E):
        monkeypatch.setattr(m, "box_pairs", lambda *a, **k: seen.append(pairs(*a, **k)) or seen[-1])
    got = E.match_candidates(t.unionByName(t), t.withColumnRenamed("det_id", "truth_id"))
    assert got.distinct().count() == got.count() == 90_000 and [p.count() for p in seen] == [1]
