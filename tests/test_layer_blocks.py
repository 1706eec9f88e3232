"""Distances to layers of any size: blocks of segments give what one pass gives."""
import random

from pingframe.operators import layers as Y


def test_blocks_of_segments_give_the_distances_of_one_pass(spark):
    r, segs = random.Random(2), []
    for f in range(9):
        n = r.choice([3, 5, 17])
        ring = [(80.0 + r.random() * 0.02, 13.0 + r.random() * 0.02) for _ in range(n)]
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            segs.append((f"L{f % 2}", f, f"n{f}", "mpa", 1.0, f % 2, f % 3 > 0, True, x0, y0, x1, y1))
    s = spark.createDataFrame(segs, "layer string, feature int, name string, kind string, weight double, ord int, is_area boolean, outer boolean, x0 double, y0 double, x1 double, y1 double")
    c = spark.createDataFrame([(f"c{i}", 13.0 + r.random() * 0.02, 80.0 + r.random() * 0.02, i) for i in range(60)], "id string, lat double, lon double, n int")
    rows = lambda limit: {(x.id, x.layer, x.feature): x.distance_m for x in Y.with_layer_distances(c, s, limit).collect()}
    whole = rows(4096)
    assert len(whole) == 60 * 9 and 0.0 in whole.values()
    assert rows(7) == whole and rows(1) == whole
    assert Y.with_layer_distances(c, s, 7).columns == Y.with_layer_distances(c, s).columns == [*c.columns, "distance_m", "layer", "feature"]
    assert Y.with_layer_distances(c, s.limit(0)).count() == 0
