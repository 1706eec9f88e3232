"""Ensembles fused from one look at the pairs; pairs of centres against all pairs."""
import random

import pytest

from pingframe.operators import detections as D
from pingframe.operators.joins import box_pairs

SCHEMA = "survey string, side string, cls string, det_id string, ping0 int, ping1 int, col0 int, col1 int, score double, model int, brain string"


def overlap(a, b):
    h = min(a["ping1"], b["ping1"]) - max(a["ping0"], b["ping0"]) + 1
    w = min(a["col1"], b["col1"]) - max(a["col0"], b["col0"]) + 1
    both = max(h, 0) * max(w, 0)
    area = lambda x: (x["ping1"] - x["ping0"] + 1) * (x["col1"] - x["col0"] + 1)
    return both / (area(a) + area(b) - both)


def boxes(n, span=60, sizes=(5, 9, 14)):
    r, rows = random.Random(7), []
    for i in range(n):
        p, c = r.randrange(-9, span), r.randrange(span)
        rows.append({"survey": r.choice("ab"), "side": "port", "cls": r.choice("xy"), "det_id": f"d{i:03d}", "ping0": p, "ping1": p + r.choice(sizes), "col0": c, "col1": c + r.choice(sizes),
                     "score": r.choice([0.25, 0.5, 0.5, 0.75]), "model": r.randrange(4), "brain": r.choice("AB")})
    return rows + [{**rows[k], "det_id": f"e{k:03d}", "model": k % 5} for k in range(n // 8)]


@pytest.mark.parametrize("route", ["pairs", "rounds", "cells"])
def test_clusters_are_those_of_a_sequential_pass(spark, monkeypatch, route):
    if route == "rounds":
        monkeypatch.setattr(D._dropped_by_pairs, "__defaults__", (10,))
        monkeypatch.setattr(D, "_dropped", lambda slim, keys, t: D._dropped_by_pairs(slim, keys, t))
    if route == "cells":
        monkeypatch.setattr(D, "PAIR_BUDGET", 0)
        monkeypatch.setattr(D, "PAIRS_PER_BOX", 0)
    looks, pairs = [], D.box_pairs
    monkeypatch.setattr(D, "box_pairs", lambda *a, **k: looks.append(1) or pairs(*a, **k))
    rows, seeds, members = boxes(300), [], {}
    for x in sorted(rows, key=lambda x: (-x["score"], x["det_id"])):
        if not any((k["survey"], k["cls"]) == (x["survey"], x["cls"]) and overlap(k, x) >= 0.55 for k in seeds):
            seeds.append(x)
    for x in rows:
        mine = min((k for k in seeds if (k["survey"], k["cls"]) == (x["survey"], x["cls"]) and overlap(k, x) >= 0.55), key=lambda k: (-k["score"], k["det_id"]))
        members.setdefault(mine["det_id"], []).append(x)
    want = {}
    for s in seeds:
        m, total = members[s["det_id"]], sum(x["score"] for x in members[s["det_id"]])
        mean = {c: round(sum(x[c] * x["score"] for x in m) / total) for c in ("ping0", "ping1", "col0", "col1")}
        want[s["det_id"]] = (s["survey"], s["cls"], s["model"], s["brain"], *mean.values(), round(min(total / 4, 0.99), 9), len({x["model"] for x in m}), len(m))
    got = D.fuse_ensemble(spark.createDataFrame(rows, SCHEMA).repartition(4), 4)
    assert {r.det_id: (r.survey, r.cls, r.model, r.brain, r.ping0, r.ping1, r.col0, r.col1, round(r.score, 9), r.n_models, r.n_members) for r in got.collect()} == want
    assert len(looks) == 1
    few = D.fuse_ensemble(spark.createDataFrame(rows, SCHEMA), 4, min_models=2)
    assert {r.det_id for r in few.collect()} == {k for k, v in want.items() if v[-2] >= 2}


@pytest.mark.parametrize("min_iou", [0.5, 0.55, 0.9])
def test_pairs_of_centres_are_all_pairs(spark, min_iou):
    rows = boxes(250, 90, (0, 1, 7, 30, 55, 130))
    t = spark.createDataFrame(rows, SCHEMA)
    got = box_pairs(t, t, ["survey", "cls"], min_iou)
    want = {(a["det_id"], b["det_id"]): overlap(a, b) for a in rows for b in rows if (a["survey"], a["cls"]) == (b["survey"], b["cls"]) and overlap(a, b) >= min_iou}
    found = [(r.l_det_id, r.r_det_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == set(want)
