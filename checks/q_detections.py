"""Box, ensemble, zone, diff and tour queries."""

from pyspark.sql import functions as F

from pingframe.functions import boxes as B
from pingframe.functions import scoring as S
from pingframe.operators import clusters as C
from pingframe.operators import detections as D
from pingframe.operators.joins import box_pairs, own_place_pairs
from pingframe.session import written

from .registry import query
from .sqltext import dist, iou

TILES = """tiles AS (SELECT r, c, CAST(r * 384 AS INT) AS row0, CAST(c * 192 AS INT) AS tcol0, r * 2 + c AS tile_index
  FROM generate_series(0, 4) a(r), generate_series(0, 1) b(c))"""


def tiles(s):
    grid = s.wide("v_detections").select("survey", "side").distinct()
    grid = grid.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return grid.select("survey", "side", (F.col("r") * 2 + F.col("c")).alias("tile_index"), (F.col("r") * 384).alias("row0"),
                       (F.col("c") * 192).alias("col0"), F.lit(512).alias("h"), F.lit(256).alias("w"))


@query("j2_tile_to_global", "v_detections", f"""
WITH {TILES}, d AS (SELECT det_id, (ping0 % 5) * 2 + model % 2 AS tile_index, col0 * 0.7::DOUBLE AS x1, ping0 * 0.27::DOUBLE AS y1,
  col1 * 0.7::DOUBLE AS x2, ping1 * 0.27::DOUBLE AS y2 FROM v_detections),
g AS (SELECT det_id, row0, tcol0, greatest(least(floor(x1), 255), 0) AS c0, greatest(least(floor(y1), 511), 0) AS r0,
  greatest(least(ceil(x2) - 1, 255), 0) AS c1, greatest(least(ceil(y2) - 1, 511), 0) AS r1 FROM d JOIN tiles USING (tile_index))
SELECT det_id, CAST(row0 + r0 AS INT) AS ping0, CAST(row0 + greatest(r1, r0) AS INT) AS ping1, CAST(tcol0 + c0 AS INT) AS col0,
  CAST(tcol0 + greatest(c1, c0) AS INT) AS col1 FROM g""")
def j2(s):
    d = s.wide("v_detections").select(
        "det_id", "survey", "side", ((F.col("ping0") % 5) * 2 + F.col("model") % 2).alias("tile_index"),
        (F.col("col0") * F.lit(0.7)).alias("x1"), (F.col("ping0") * F.lit(0.27)).alias("y1"),
        (F.col("col1") * F.lit(0.7)).alias("x2"), (F.col("ping1") * F.lit(0.27)).alias("y2"))
    return D.tile_detections_to_global(d, tiles(s)).select("det_id", *B.BOX)


@query("j3_tiles_of_point", "v_detections", f"""
WITH {TILES} SELECT det_id, tile_index, CAST(ping0 - row0 AS INT) AS r, CAST(col0 - tcol0 AS INT) AS c FROM v_detections JOIN tiles
ON ping0 >= row0 AND ping0 < row0 + 512 AND col0 >= tcol0 AND col0 < tcol0 + 256""")
def j3(s):
    from pingframe.operators.joins import range_join
    t = tiles(s).withColumnsRenamed({"col0": "tcol0"}).withColumn("row1", F.col("row0") + F.col("h") - 1)
    j = range_join(s.wide("v_detections"), t, ["survey", "side"], "ping0", "row0", "row1")
    loc = B.global_to_tile("ping0", "col0", "row0", "tcol0", "h", "w")
    return j.withColumn("loc", loc).where("loc IS NOT NULL").select("det_id", F.col("tile_index").cast("bigint"), F.col("loc.r").alias("r"), F.col("loc.c").alias("c"))


@query("j6_box_pairs", "v_detections", f"""
SELECT a.det_id AS a_id, b.det_id AS b_id, round({iou()}, 9) AS iou FROM v_detections a JOIN v_detections b
ON a.survey = b.survey AND a.side = b.side AND a.cls = b.cls AND a.det_id < b.det_id
WHERE a.ping0 <= b.ping1 AND b.ping0 <= a.ping1 AND a.col0 <= b.col1 AND b.col0 <= a.col1 AND {iou()} >= 0.25""")
def j6(s):
    d = s.wide("v_detections").select("det_id", "survey", "side", "cls", *B.BOX)
    p = own_place_pairs(d, ["survey", "side", "cls"], 0.25, "det_id")
    return p.select(F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id"), F.round("iou", 9).alias("iou"))


@query("w12_rank_in_class", "v_detections", """
SELECT det_id, CAST(row_number() OVER (PARTITION BY survey, side, cls ORDER BY score DESC, det_id) AS INT) AS rank FROM v_detections""")
def w12(s):
    return D.rank_in_class(s.wide("v_detections")).select("det_id", "rank")


def _abc(s):
    d = s.wide("v_detections")
    return d.where("brain = 'A'"), d.where("brain = 'C'"), d.where("brain = 'B'")


@query("j7_corroboration", "v_detections", f"""
WITH h AS (SELECT a.det_id AS a_id, b.det_id AS c_id FROM v_detections a JOIN v_detections b ON a.survey = b.survey AND a.side = b.side
  WHERE a.brain = 'A' AND b.brain = 'C' AND a.ping0 <= b.ping1 AND b.ping0 <= a.ping1 AND {iou()} >= 0.3)
SELECT det_id, CASE WHEN det_id IN (SELECT a_id FROM h) THEN 'AC' ELSE brain END AS brain,
  round(CASE WHEN det_id IN (SELECT a_id FROM h) THEN least(score + 0.05, 0.99) ELSE score END, 6) AS score
FROM v_detections WHERE brain = 'A' OR (brain = 'C' AND det_id NOT IN (SELECT c_id FROM h))""")
def j7(s):
    a, c, _ = _abc(s)
    return D.corroborate(a, c).select("det_id", "brain", F.round("score", 6).alias("score"))


@query("j8_merge_brains", "v_detections", f"""
WITH h AS (SELECT a.det_id AS a_id, b.det_id AS c_id FROM v_detections a JOIN v_detections b ON a.survey = b.survey AND a.side = b.side
  WHERE a.brain = 'A' AND b.brain = 'C' AND {iou()} >= 0.3),
base AS (SELECT * REPLACE (CASE WHEN det_id IN (SELECT a_id FROM h) THEN 'AC' ELSE brain END AS brain,
  CASE WHEN det_id IN (SELECT a_id FROM h) THEN least(score + 0.05, 0.99) ELSE score END AS score)
  FROM v_detections WHERE brain = 'A' OR (brain = 'C' AND det_id NOT IN (SELECT c_id FROM h))),
n AS (SELECT a.det_id, count(*) AS n FROM base a JOIN v_detections b ON a.survey = b.survey AND a.side = b.side
  WHERE b.brain = 'B' AND {iou()} >= 0.3 GROUP BY a.det_id)
SELECT base.det_id, CASE WHEN n IS NULL THEN brain WHEN brain = 'A' THEN 'AB' WHEN brain = 'AC' THEN 'ABC' ELSE 'BC' END AS brain,
  round(CASE WHEN n IS NULL THEN score ELSE least(score + 0.05 * n, 0.99) END, 6) AS score FROM base LEFT JOIN n USING (det_id)""")
def j8(s):
    merged = D.merge_brains(*_abc(s))
    return merged.where("brain <> 'B' ").select("det_id", "brain", F.round("score", 6).alias("score"))


@query("u1_brain_union", "v_detections", """
WITH p AS (SELECT DISTINCT brain, survey, side, ping0, ping1, col0, col1 FROM v_detections), a AS (SELECT * EXCLUDE (brain) FROM p WHERE brain = 'A'), c AS (SELECT * EXCLUDE (brain) FROM p WHERE brain = 'C'),
r AS (SELECT survey, side FROM v_detections WHERE brain = 'A'
  UNION ALL SELECT survey, side FROM v_detections d WHERE brain = 'C' AND NOT EXISTS (SELECT 1 FROM a WHERE (a.survey, a.side, a.ping0, a.ping1, a.col0, a.col1) = (d.survey, d.side, d.ping0, d.ping1, d.col0, d.col1))
  UNION ALL SELECT survey, side FROM p d WHERE brain = 'B' AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM a UNION SELECT * FROM c) x
    WHERE (x.survey, x.side, x.ping0, x.ping1, x.col0, x.col1) = (d.survey, d.side, d.ping0, d.ping1, d.col0, d.col1)))
SELECT survey, side, count(*) AS n FROM r GROUP BY ALL""")
def u1(s):
    """The three lists in one, with only equal boxes merged."""
    return D.merge_brains(*_abc(s), iou=1.0).groupBy("survey", "side").agg(F.count("*").alias("n"))


@query("g1_suppressed")
def g1(s):
    return D.merge_detections(s.wide("v_detections"), 0.4).select("det_id", "score")


@query("g1_no_overlap_left", "v_detections", "SELECT det_id AS a_id, det_id AS b_id FROM v_detections WHERE 1 = 0")
def g1_check(s):
    keys = ["survey", "side", "cls"]
    kept = written(D.greedy_keep(s.wide("v_detections"), keys, 0.4).select("det_id", *keys, *B.BOX))
    bad = D.suppression_violations(kept, keys, 0.4)
    return bad.select(F.col("l_det_id").alias("a_id"), F.col("r_det_id").alias("b_id"))


@query("g1_every_drop_explained", "v_detections", "SELECT count(*) AS n FROM v_detections")
def g1_explained(s):
    """kept + dropped-by-a-stronger-kept covers the input."""
    keys = ["survey", "side", "cls"]
    d = s.wide("v_detections")
    kept = written(D.greedy_keep(d, keys, 0.4).select("det_id", "score", *keys, *B.BOX))
    p = box_pairs(d.select("det_id", "score", *keys, *B.BOX), kept, keys, 0.4, bucket=96, large_left=True)
    stronger = (F.col("r_score") > F.col("l_score")) | ((F.col("r_score") == F.col("l_score")) & (F.col("r_det_id") <= F.col("l_det_id")))
    return p.where(stronger).agg(F.count_distinct("l_det_id").alias("n"))


@query("g2_fused_ensemble")
def g2(s):
    return D.fuse_ensemble(s.wide("v_detections"), 7, 0.55, 2).select("det_id", *B.BOX, "score", "n_models")


@query("a37_ensemble_members", "v_detections", "SELECT count(*) AS members, round(sum(score), 4) AS total FROM v_detections")
def a37(s):
    """Every detection belongs to exactly one cluster."""
    f = D.fuse_ensemble(s.wide("v_detections").withColumn("score", F.col("score") / 100), 7, 0.55)
    return f.agg(F.sum("n_members").alias("members"), F.round(F.sum("score") * 700, 4).alias("total"))


@query("x33_snr_score", "v_contacts", """
SELECT id, round(greatest((confidence - severity) / (depth_m + 1), 0) / (greatest((confidence - severity) / (depth_m + 1), 0) + 6), 9) AS s FROM v_contacts""")
def x33(s):
    return s.v_contacts.select("id", F.round(S.snr_score("confidence", "severity", F.col("depth_m") + 1), 9).alias("s"))


@query("x34_anomaly_score", "v_contacts", "SELECT id, round(least(confidence / (depth_m + 1) / 2, 0.99), 9) AS s FROM v_contacts")
def x34(s):
    return s.v_contacts.select("id", F.round(S.anomaly_score("confidence", F.col("depth_m") + 1), 9).alias("s"))


@query("j12_survey_diff", "v_contacts", f"""
WITH p AS (SELECT b.id AS id, a.id AS a_id, {dist('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM v_contacts a, v_contacts b
  WHERE a.survey = 'S0' AND b.survey = 'S1' AND abs(a.lat - b.lat) < 0.0003 AND abs(a.lon - b.lon) < 0.0003),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, a_id) AS r FROM p WHERE d <= 25) q WHERE r = 1)
SELECT b.id, CASE WHEN m.id IS NULL THEN 'new' ELSE 'matched' END AS status, a_id, round(d, 4) AS d FROM v_contacts b
LEFT JOIN m ON m.id = b.id WHERE b.survey = 'S1'""")
def j12(s):
    c = s.v_contacts.select("id", "survey", "lat", "lon")
    d = C.diff_surveys(c.where("survey = 'S0'"), c.where("survey = 'S1'"), digits=None)
    return d.select("id", "status", "a_id", F.round("distance_m", 4).alias("d"))


CAND = f"""cand AS (SELECT a.id AS a_id, b.id AS b_id, {dist('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM v_contacts a, v_contacts b
  WHERE a.survey = 'S0' AND b.survey = 'S1' AND abs(a.lat - b.lat) < 0.0003 AND abs(a.lon - b.lon) < 0.0003
  AND (a.cls = b.cls OR a.cls = 'unknown_anomaly' OR b.cls = 'unknown_anomaly'))"""


@query("j14_confirm_candidates", "v_contacts", f"WITH {CAND} SELECT a_id, b_id, round(d, 4) AS d FROM cand WHERE d <= 15")
def j14(s):
    c = s.v_contacts
    p = C.confirm_candidates(c.where("survey = 'S0'"), c.where("survey = 'S1'"))
    return p.select("a_id", "b_id", F.round("distance_m", 4).alias("d"))


@query("g6_cross_confirm")
def g6(s):
    c = s.v_contacts.select("id", "survey", "cls", "lat", "lon", "confidence")
    return C.cross_confirm(c.where("survey = 'S0'"), c.where("survey = 'S1'"))


@query("u4_unmatched_only", "v_contacts", "SELECT survey, count(*) AS n FROM v_contacts WHERE survey IN ('S0', 'S1') GROUP BY survey")
def u4(s):
    """Confirmed and lone contacts together are each pass, once."""
    c = s.v_contacts.select("id", "survey", "cls", "lat", "lon", "confidence")
    x = C.cross_confirm(c.where("survey = 'S0'"), c.where("survey = 'S1'"))
    return x.groupBy("survey").agg(F.count_distinct("id").alias("n"))


@query("j17_linkage_pairs", "v_contacts", f"""
SELECT a.id AS a_id, b.id AS b_id, round({dist('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS d FROM v_contacts a JOIN v_contacts b
ON a.survey = b.survey AND a.id < b.id AND abs(a.lat - b.lat) < 0.0003 AND abs(a.lon - b.lon) < 0.0003
WHERE {dist('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 12""")
def j17(s):
    from pingframe.operators.joins import radius_pairs
    c = s.v_contacts.select("id", "survey", "lat", "lon")
    p = radius_pairs(c, c, 12.0, ["survey"], extra=F.col("l_id") < F.col("r_id"))
    return p.select(F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id"), F.round("distance_m", 4).alias("d"))


ZONES = f"""RECURSIVE e AS (SELECT a.id AS x, b.id AS y FROM v_contacts a JOIN v_contacts b
  ON a.survey = b.survey AND abs(a.lat - b.lat) < 0.0003 AND abs(a.lon - b.lon) < 0.0003
  WHERE {dist('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 12),
walk AS (SELECT id, id AS zone FROM v_contacts UNION SELECT e.y, walk.zone FROM walk JOIN e ON walk.id = e.x WHERE walk.zone < e.y),
lab AS (SELECT id, min(zone) AS zone FROM walk GROUP BY id)"""


@query("g4_linkage_zones", "v_contacts", f"WITH {ZONES} SELECT id, zone FROM lab")
def g4(s):
    return C.linkage_labels(s.v_contacts, 12.0).select("id", "zone")


@query("a36_zone_centroids", "v_contacts", f"""
WITH {ZONES} SELECT survey, zone, count(*) AS n, sum(severity) AS total_severity,
  round(CASE WHEN sum(severity) > 0 THEN sum(lat * severity) / sum(severity) ELSE avg(lat) END, 6) AS centroid_lat
FROM v_contacts JOIN lab USING (id) GROUP BY survey, zone""")
def a36(s):
    c = s.v_contacts
    z = C.zones(c, C.linkage_labels(c, 12.0))
    return z.select("survey", "zone", "n", "total_severity", F.round("centroid_lat", 6).alias("centroid_lat"))


@query("t5_zone_order", "v_contacts", f"""
WITH {ZONES} SELECT survey, zone, sum(severity) AS total_severity FROM v_contacts JOIN lab USING (id) GROUP BY survey, zone
HAVING count(*) >= 2 ORDER BY total_severity DESC, zone LIMIT 25""")
def t5(s):
    c = s.v_contacts
    return C.zones(c, C.linkage_labels(c, 12.0), min_size=2).limit(25).select("survey", "zone", "total_severity")


@query("g7_zone_tours")
def g7(s):
    c = s.v_contacts
    lab = C.linkage_labels(c, 12.0).select("id", "zone")
    return C.zone_tours(c.join(lab, "id")).select("survey", "zone", "part", "id", "seq", F.round("leg_m", 3).alias("leg_m"))


@query("g7_tour_covers_zone", "v_contacts", f"""
WITH {ZONES} SELECT survey, zone, count(*) AS stops, CAST(count(*) AS INT) AS last_seq FROM v_contacts JOIN lab USING (id) GROUP BY survey, zone""")
def g7_cover(s):
    c = s.v_contacts
    t = C.zone_tours(c.join(C.linkage_labels(c, 12.0).select("id", "zone"), "id"))
    return t.groupBy("survey", "zone").agg(F.count_distinct("id").alias("stops"), F.max("seq").alias("last_seq"))


@query("w11_tour_legs", "v_contacts", f"""
SELECT survey, count(*) AS stops, round(sum(coalesce({dist('plat', 'plon', 'lat', 'lon')}, 0)), 3) AS total_m FROM (SELECT *, lag(lat) OVER w AS plat,
  lag(lon) OVER w AS plon FROM v_contacts WINDOW w AS (PARTITION BY survey ORDER BY seq)) q GROUP BY survey""")
def w11(s):
    from pingframe.operators.scale import ranked
    c = s.v_contacts.select("survey", "id", "lat", "lon", F.col("seq").alias("_s"))
    legs = C.tour_legs(ranked(c, ["survey"], [F.asc("_s")], "seq"), ("survey",))
    return legs.groupBy("survey").agg(F.count("*").alias("stops"), F.round(F.sum("leg_m"), 3).alias("total_m"))


@query("g8_tour_is_complete", "v_contacts", """
SELECT survey, count(*) AS stops, CAST(count(*) AS INT) AS last_seq, count(*) AS places, count(*) AS legs FROM v_contacts GROUP BY survey""")
def g8_complete(s):
    c = s.v_contacts
    t = C.cluster_tours(c, C.linkage_labels(c, 12.0), start=(13.05, 80.35))
    return t.groupBy("survey").agg(F.count_distinct("id").alias("stops"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("places"), F.count("leg_m").alias("legs"))


@query("g8_cluster_tours")
def g8(s):
    c = s.v_contacts
    return C.cluster_tours(c, C.linkage_labels(c, 12.0), start=(13.05, 80.35)).select("survey", "zone", "zone_seq", "id", "seq")
