"""A detector of the user's over tile tensors: what it sees, what it may return, where its boxes land."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.operators import conditioning as C
from pingframe.operators import injected as J


def bright(limit):
    """A toy model: the bounding box of all pixels above a limit."""
    def opened():
        def find(tensor):
            out = {c: [] for c in J.BOXES}
            for i, image in enumerate(tensor):
                r, c = np.nonzero(np.nan_to_num(image, nan=-1.0) > limit)
                if len(r):
                    for name, v in zip(J.BOXES, (i, c.min(), r.min(), c.max() + 1, r.max() + 1, "bright", len(r) / image.size)):
                        out[name].append(v)
            return out
        return find
    return opened


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(3)
    rows = []
    for survey, pings, cols in (("007", 75, 40), ("b", 9, 70)):
        for side in ("port", "starboard"):
            m = rng.uniform(0, 100, (pings, cols)).round(3)
            m[rng.random(m.shape) < 0.1] = np.nan
            rows += [(survey, side, p, [None if np.isnan(v) else float(v) for v in m[p]]) for p in range(pings)]
    ground = spark.createDataFrame(rows, "survey string, side string, ping int, cols array<double>").repartition(5)
    shape = ground.groupBy("survey", "side").agg(F.count("*").alias("n_pings"), F.max(F.size("cols")).alias("n_cols"))
    return ground, shape, {(s, d, p): c for s, d, p, c in rows}


@pytest.mark.parametrize("batch", [1, 3, 16])
def test_toy_detector_gives_the_boxes_of_the_image(image, batch):
    ground, shape, pixels = image
    got = {(r.survey, r.side, r.tile_index): r for r in J.detect(ground, shape, bright(97.0), tile=16, batch=batch).collect()}
    tiles = C.tiles_of(ground, shape, 16).collect()
    assert len({t.h for t in tiles}) > 1
    for t in tiles:
        hits = [(t.row0 + r, t.col0 + c) for r in range(t.h) for c in range(t.w) if (pixels[t.survey, t.side, t.row0 + r][t.col0 + c] or 0) > np.float32(97.0)]
        r = got.pop((t.survey, t.side, t.tile_index), None)
        if hits:
            assert (r.ping0, r.ping1, r.col0, r.col1) == (min(h[0] for h in hits), max(h[0] for h in hits), min(h[1] for h in hits), max(h[1] for h in hits))
            assert (r.cls, r.brain, r.det_id) == ("bright", "A", f"{t.survey}|{t.side}|{t.tile_index}|0") and r.score == pytest.approx(len(hits) / (t.h * t.w))
        else:
            assert r is None
    assert not got


def test_ids_are_the_same_for_any_partitioning(image):
    ground, shape, _ = image

    def opened():
        return lambda x: {"tile": [i for i in range(len(x)) for _ in range(3)], "x1": [2.0, 0.0, 1.0] * len(x), "y1": [0.0] * 3 * len(x), "x2": [3.0] * 3 * len(x),
                          "y2": [1.0] * 3 * len(x), "cls": ["c", "a", "b"] * len(x), "score": [0.5] * 3 * len(x)}

    one, two = ({r.det_id: r.cls for r in J.detect(g, shape, opened, tile=16, batch=b).collect()} for g, b in ((ground, 2), (ground.coalesce(1), 7)))
    assert one == two and one["007|port|0|0"] == "a" and one["007|port|0|2"] == "c"


def test_wrong_answers_raise(image):
    good = {"tile": [0], "x1": [0.0], "y1": [0.0], "x2": [1.0], "y2": [1.0], "cls": ["a"], "score": [0.5]}
    assert J.checked_boxes(good, 1)["cls"].tolist() == ["a"] and len(J.checked_boxes({c: [] for c in J.BOXES}, 4)["tile"]) == 0
    for wrong, word in (({"extra": [1]}, "unknown"), ({"tile": [1]}, "tile numbers"), ({"score": [1.5]}, "score"), ({"x1": [2.0]}, "x1 <= x2"), ({"y2": [np.nan]}, "finite"), ({"cls": ["a", "b"]}, "length")):
        with pytest.raises(ValueError, match=word):
            J.checked_boxes(good | wrong, 1)
    with pytest.raises(ValueError, match="missing"):
        J.checked_boxes({}, 1)
    ground, shape, _ = image
    with pytest.raises(Exception, match="unknown"):
        J.detect(ground, shape, lambda: lambda x: good | {"extra": [1]}, tile=16).collect()


def test_a_worker_opens_a_detector_once():
    opened = []
    find = J._open("one", lambda: opened.append(1) or (lambda x: 1))
    assert J._open("one", lambda: opened.append(1)) is find and J._open("two", lambda: opened.append(2) or "next") == "next" and opened == [1, 2]
