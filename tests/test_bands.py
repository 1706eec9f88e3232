"""Greedy suppression in tasks that hold a group or a band of pings, against the sequential answer."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.operators import bands as N
from pingframe.operators import detections as D
from pingframe.operators.joins import box_pairs
from pingframe.session import SHUFFLE_CLEANUP, written

from .test_suppression import overlap

SCHEMA = "survey string, side string, cls string, det_id string, ping0 int, ping1 int, col0 int, col1 int, score double"
KEYS = ["survey", "side", "cls"]


def boxes(n=600, span=400):
    r, rows = random.Random(5), []
    for i in range(n):
        p, c = r.randrange(-9, span), r.randrange(30)
        rows.append({"survey": r.choice("aaab"), "side": "port", "cls": "x", "det_id": f"d{i:03d}", "ping0": p, "ping1": p + r.choice([5, 9, 14, 70]), "col0": c, "col1": c + r.choice([5, 9, 14]),
                     "score": r.choice([0.2, 0.5, 0.5, 0.9, float("nan"), None])})
    return rows + [{**rows[k], "det_id": f"e{k:03d}"} for k in range(40)] + [{**rows[0], "det_id": "n0", "ping0": None}, {**rows[1], "det_id": "n1", "survey": None}]


def strength(x):
    s = x["score"]
    return (0 if s is None else 2 if s != s else 1, 0.0 if s is None or s != s else -s, x["det_id"])


def sequential(rows, t):
    kept, seeds = [], {}
    meets = lambda k, x: None not in (x["ping0"], x["survey"], k["ping0"], k["survey"]) and k["survey"] == x["survey"] and overlap(k, x) >= t
    for x in sorted(rows, key=strength):
        by = next((k for k in kept if meets(k, x)), None)
        if by is None:
            kept.append(x)
        else:
            seeds[x["det_id"]] = by["det_id"]
    return kept, seeds


@pytest.mark.parametrize("most", [200_000, 110])
@pytest.mark.parametrize("t", [0.3, 0.55])
def test_bands_give_the_sequential_answer_without_pairs(spark, monkeypatch, most, t):
    monkeypatch.setattr(D, "LISTED_BOXES", 0)
    monkeypatch.setattr(D, "_keep_by_cells", None)
    monkeypatch.setattr(D, "_keep_by_pairs", None)
    monkeypatch.setattr(N, "BAND_BOXES", most)
    rows = boxes()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept, seeds = sequential(rows, t)
    assert sorted(x.det_id for x in D.greedy_keep(table, KEYS, t).collect()) == sorted(k["det_id"] for k in kept)
    one = {(*[x[k] for k in D.BOX], x["survey"]): x for x in sorted(rows, key=strength, reverse=True)}.values()
    slim = spark.createDataFrame([dict(x) for x in one], SCHEMA).withColumn("_prio", D.by_score())
    got = N.dropped_in_bands(slim, KEYS, D._order(slim), t)
    ids = {x["det_id"] for x in one}
    assert {(r.det_id, r.seed) for r in got.collect()} == {(k, v) for k, v in seeds.items() if k in ids}


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("pairs", [1_000_000, 50])
def test_boxes_are_settled_block_by_block_in_order(monkeypatch, block, pairs):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PAIRS", pairs)
    rows = sorted((x for x in boxes() if None not in (x["ping0"], x["survey"]) and x["survey"] == "a"), key=strength)
    kept, seeds = sequential(rows, 0.3)
    box = np.array([[x[c] for x in rows] for c in D.BOX], float)
    state, seed = N.settle(box, np.arange(len(rows)), np.zeros(len(rows), np.int8), np.ones(len(rows), bool), 0.3)
    assert {rows[i]["det_id"] for i in np.flatnonzero(state == N.KEPT)} == {k["det_id"] for k in kept}
    assert {rows[i]["det_id"]: rows[seed[i]]["det_id"] for i in np.flatnonzero(state == N.DROPPED)} == seeds


def test_an_id_that_names_two_boxes_is_dropped_with_one_of_them(spark, monkeypatch):
    at = lambda i, p, s: {"survey": "a", "side": "port", "cls": "x", "det_id": i, "ping0": p, "ping1": p + 9, "col0": 0, "col1": 9, "score": s}
    table = spark.createDataFrame([at("a", 0, 0.9), at("b", 1, 0.5), at("b", 50, 0.5), at("c", 51, 0.4)], SCHEMA)
    by_pairs = sorted(r.det_id for r in D.greedy_keep(table, KEYS, 0.5).collect())
    monkeypatch.setattr(D, "LISTED_BOXES", 0)
    assert sorted(r.det_id for r in D.greedy_keep(table, KEYS, 0.5).collect()) == by_pairs == ["a", "c"]


def test_clusters_fused_in_tasks_are_those_of_the_pairs(spark, monkeypatch):
    rows = [{**x, "model": None if i % 50 == 3 else i % 4, "brain": "AB"[i % 2]} for i, x in enumerate(boxes())]
    rows = [{**x, "score": {0.2: 0.25, 0.5: 0.5, 0.9: 0.75}.get(x["score"], 0.125)} for x in rows]      # sums are exact in any order
    rows += rows[5:15]                                # rows that come twice
    table = spark.createDataFrame(rows, SCHEMA + ", model int, brain string").repartition(3)
    told = lambda t: sorted(repr((r.det_id, r.survey, r.cls, r.brain, r.model, r.n_models, r.n_members, r.ping0, r.ping1, r.col0, r.col1, round(r.score, 9))) for r in D.fuse_ensemble(t, 4, 0.4).collect())
    by_pairs = told(table)
    monkeypatch.setattr(D, "LISTED_BOXES", 0)
    with monkeypatch.context() as m:
        m.setattr(D, "_dropped", None)
        assert told(table) == by_pairs and len(by_pairs) > 100
    monkeypatch.setattr(N, "BAND_BOXES", 150)         # groups too large for a task
    assert told(table) == by_pairs
    again = table.unionByName(table.where("det_id = 'd007'").withColumn("ping0", F.col("ping0") - 500).withColumn("ping1", F.col("ping1") - 500))
    assert N.fused_in_groups(again, KEYS, 0.4) is None


def test_a_crowded_strip_goes_by_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BAND_BOXES", 10)
    table = spark.createDataFrame([{**x, "ping0": 3, "ping1": 9} for x in boxes(90)[:90]], SCHEMA).withColumn("_prio", D.by_score())
    assert N.dropped_in_bands(table, KEYS, D._order(table), 0.4) is None


def test_a_large_left_side_is_sent_once_and_gives_the_same_pairs(spark):
    rows = boxes(200)
    table = spark.createDataFrame(rows, SCHEMA)
    found = [sorted((r.l_det_id, r.r_det_id, r.iou) for r in box_pairs(table, table, ["survey", "cls"], 0.2, large_left=large).collect()) for large in (False, True)]
    assert found[0] == found[1] and len(found[0]) > 200
    left = lambda large: box_pairs(table, table, ["survey"], 0.2, large_left=large)._jdf.queryExecution().optimizedPlan().toString().count("Generate")
    assert left(True) < left(False)


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, set_to = files(), spark.conf.get(SHUFFLE_CLEANUP, "false")
    table, until = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()), time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert (files() <= before, spark.conf.get(SHUFFLE_CLEANUP, "false"), table.count()) == (True, set_to, 7)
