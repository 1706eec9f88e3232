"""Shadow analysis, feature, verifier and classical-detector queries."""

from pyspark.sql import functions as F

from pingframe import constants as K
from pingframe.functions import scoring as S
from pingframe.functions.boxes import BOX
from pingframe.operators import conditioning as C
from pingframe.operators import physics as PH
from pingframe.operators import verifier as V
from pingframe.plans.contacts import build_contacts

from .q_conditioning import KEYS, nav, shape, traces
from .registry import query

# planted highlights (cols 42-46) and shadows (47-55) on half the pings
PLANT = """CASE WHEN ping % 10 < 6 AND col BETWEEN 42 AND 46 THEN v * 3 WHEN ping % 10 < 6 AND col BETWEEN 47 AND 55 THEN v * 0.2::DOUBLE ELSE v END"""
GROUND = f"gr AS MATERIALIZED (SELECT survey, side, ping, col, CASE WHEN (col + ping) % 17 <> 3 THEN {PLANT} END AS v FROM v_samples)"
DETS = """dt AS (SELECT DISTINCT survey, side, ping AS p, concat(survey, side, ping) AS det_id FROM v_samples),
sz AS (SELECT survey, max(ping) AS last FROM v_samples GROUP BY survey),
dx AS (SELECT det_id, survey, side, p AS ping0, least(p + 5, last) AS ping1, 40 + p % 4 AS col0, 44 + p % 4 AS col1 FROM dt JOIN sz USING (survey))"""
RES = 0.5


def ground(s):
    def v(x, i):
        lit = (F.col("ping") % 10 < 6) & i.between(42, 46)
        dark = (F.col("ping") % 10 < 6) & i.between(47, 55)
        y = F.when(lit, x * 3).when(dark, x * F.lit(0.2)).otherwise(x)
        return F.when((i + F.col("ping")) % 17 != 3, y)
    return traces(s).select(*KEYS, F.transform("samples", v).alias("cols"))


def grid(s):
    return shape(s).withColumn("ground_res", F.lit(RES))


def dets(s):
    p = F.col("ping")
    return traces(s).select(
        F.concat("survey", "side", p.cast("string")).alias("det_id"), "survey", "side", p.alias("ping0"), (p + 5).alias("ping1"),
        (40 + p % 4).alias("col0"), (44 + p % 4).alias("col1"), F.lit("container").alias("cls"),
        (F.lit(0.5) + (p % 5) * F.lit(0.1)).alias("score"), F.lit("A").alias("brain"))


def altitude(s):
    return s.v_nav.select("survey", "ping", F.coalesce("altitude", F.lit(8.0)).alias("altitude_m"))


LEVEL = f"""{GROUND}, {DETS}, px AS MATERIALIZED (SELECT det_id, d.ping0, d.ping1, col0, col1, g.ping, g.col, g.v FROM dx d JOIN gr g ON g.survey = d.survey AND g.side = d.side
  AND g.ping BETWEEN d.ping0 AND d.ping1),
lv AS (SELECT det_id, median(v) FILTER (col >= greatest(col0 - 44, 0) AND col < greatest(col0 - 4, 0)) AS near, median(v) FILTER (col >= col1 + 4 AND col < col1 + 44) AS far,
  median(v) FILTER (col BETWEEN col0 AND col1) AS box FROM px GROUP BY det_id),
bg AS (SELECT det_id, CASE WHEN near > 0 THEN near WHEN far > 0 THEN far END AS background, box FROM lv)"""


@query("j5_crops", "v_samples", f"""
WITH {GROUND}, {DETS} SELECT det_id, count(*) AS px, count(v) AS finite FROM dx d JOIN gr g ON g.survey = d.survey AND g.side = d.side
AND g.ping BETWEEN d.ping0 AND d.ping1 AND g.col BETWEEN col0 AND col1 GROUP BY det_id""")
def j5(s):
    d = PH.clip_boxes(dets(s), grid(s)).withColumns({"lo_col": F.col("col0"), "hi_col": F.col("col1")})
    crop = PH.crop_rows(d, ground(s))
    return crop.groupBy("det_id").agg(F.sum(F.size("cols")).alias("px"), F.sum(F.size(F.filter("cols", lambda v: v.isNotNull()))).alias("finite"))


@query("a9_backgrounds", "v_samples", f"WITH {LEVEL} SELECT det_id, round(background, 6) AS background, round(box / background, 6) AS highlight_ratio FROM bg")
def a9(s):
    a = PH.analyse_shadows(dets(s), ground(s), altitude(s), grid(s))
    return a.select("det_id", F.round("analysis.background", 6).alias("background"), F.round("analysis.highlight_ratio", 6).alias("highlight_ratio"))


SHADOW = f"""{LEVEL}, al AS (SELECT det_id, avg(altitude) AS alt FROM dx JOIN (SELECT survey, ping, coalesce(altitude, 8) AS altitude FROM v_nav) n
  ON n.survey = dx.survey AND n.ping BETWEEN ping0 AND ping1 GROUP BY det_id),
ge AS (SELECT dx.*, alt, (col1 + 0.5) * 0.5::DOUBLE AS xf, round_even((ping1 - ping0 + 1) * 0.2::DOUBLE, 0) AS mg FROM dx JOIN al USING (det_id)),
gs AS (SELECT *, least(greatest(ceil(xf * alt / (alt - least(20, 0.9 * alt)) / 0.5 - 0.5), col1 + 1), 64) AS hi, CASE WHEN ping1 - ping0 + 1 - 2 * mg >= 1 THEN mg ELSE 0 END AS m FROM ge),
dk AS (SELECT p.det_id, p.col - p.col1 - 1 AS j, coalesce(count(*) FILTER (v < 0.5 * background) / nullif(count(v), 0)::DOUBLE, 0) AS f
  FROM px p JOIN gs USING (det_id) JOIN bg USING (det_id) WHERE p.col > p.col1 AND p.col < hi AND p.ping BETWEEN gs.ping0 + m AND gs.ping1 - m AND background IS NOT NULL GROUP BY ALL),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY det_id ORDER BY j) AS g FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY det_id ORDER BY j) <= 3 THEN 0 ELSE 1 END AS nw FROM dk WHERE f >= 0.6) q),
rn AS (SELECT det_id, min(j) AS a, max(j) AS b FROM isl WHERE g = 1 GROUP BY det_id HAVING min(j) < 4 AND max(j) - min(j) >= 1)"""


@query("a10_dark_columns", "v_samples v_nav", f"WITH {SHADOW} SELECT det_id, CAST(j AS INT) AS j, round(f, 6) AS dark_frac FROM dk")
def a10(s):
    d = PH.shadow_geometry(PH.clip_boxes(dets(s), grid(s)), altitude(s))
    crop = PH.crop_rows(d, ground(s))
    return PH.dark_columns(crop, PH.backgrounds(crop).where("background IS NOT NULL").select("det_id", "background")).withColumn(
        "dark_frac", F.round("dark_frac", 6))


@query("w8_shadow_runs", "v_samples v_nav", f"WITH {SHADOW} SELECT det_id, CAST(a AS INT) AS run_start, CAST(b AS INT) AS run_end FROM rn")
def w8(s):
    d = PH.shadow_geometry(PH.clip_boxes(dets(s), grid(s)), altitude(s))
    crop = PH.crop_rows(d, ground(s))
    return PH.shadow_runs(PH.dark_columns(crop, PH.backgrounds(crop).where("background IS NOT NULL").select("det_id", "background")))


@query("a11_shadow_heights", "v_samples v_nav", f"""
WITH {SHADOW}, sh AS (SELECT det_id, median(v) AS shade FROM px p JOIN gs USING (det_id) JOIN rn USING (det_id) WHERE p.col - p.col1 - 1 BETWEEN a AND b AND p.col < hi
  AND p.ping BETWEEN gs.ping0 + m AND gs.ping1 - m GROUP BY det_id)
SELECT gs.det_id, rn.b IS NOT NULL AS has_shadow, coalesce(box / background >= 1.4, false) AS has_highlight, round(coalesce((b + 1) * 0.5, 0)::DOUBLE, 6) AS shadow_len_m,
  round(shade / background, 6) AS shadow_ratio, round(alt * ((col1 + b + 1.5) * 0.5 - xf) / ((col1 + b + 1.5) * 0.5), 6) AS height_m
FROM gs JOIN bg USING (det_id) LEFT JOIN rn USING (det_id) LEFT JOIN sh USING (det_id)""")
def a11(s):
    a = PH.analyse_shadows(dets(s), ground(s), altitude(s), grid(s))
    f = lambda n: F.round(f"analysis.{n}", 6).alias(n)
    return a.select("det_id", "analysis.has_shadow", "analysis.has_highlight", f("shadow_len_m"), f("shadow_ratio"), f("height_m"))


@query("a15_texture_entropy", "v_samples", f"""
WITH {GROUND}, {DETS}, p AS (SELECT det_id, v, g.ping BETWEEN ping0 AND ping1 AND col BETWEEN col0 AND col1 AS i FROM dx d JOIN gr g ON g.survey = d.survey AND g.side = d.side
  AND g.ping BETWEEN ping0 - 8 AND ping1 + 8 AND col BETWEEN col0 - 8 AND col1 + 8 WHERE v IS NOT NULL),
e AS (SELECT det_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY det_id), h AS (SELECT det_id, i, least(floor((v - lo) / (hi - lo) * 16), 15) AS b, count(*) AS n FROM p JOIN e USING (det_id) GROUP BY ALL),
t AS (SELECT det_id, i, sum(n) AS t FROM h GROUP BY ALL)
SELECT det_id, round(sum(CASE WHEN i THEN -1 ELSE 1 END * (n / t) * log2(n / t)), 6) AS delta FROM h JOIN t USING (det_id, i) GROUP BY det_id""")
def a15(s):
    return PH.texture_entropy_delta(PH.clip_boxes(dets(s), grid(s)), ground(s)).select("det_id", F.round("texture_entropy_delta", 6).alias("delta"))


@query("a17_shadow_linearity")
def a17(s):
    d = PH.shadow_geometry(PH.clip_boxes(dets(s), grid(s)), altitude(s))
    crop = PH.crop_rows(d, ground(s))
    return PH.shadow_linearity(crop, PH.backgrounds(crop))


@query("a16_contour_regularity")
def a16(s):
    d = PH.shadow_geometry(PH.clip_boxes(dets(s), grid(s)), altitude(s))
    crop = PH.crop_rows(d, ground(s))
    return PH.contour_regularity(crop, PH.backgrounds(crop))


@query("x32_features")
def x32(s):
    return PH.features(dets(s), ground(s), altitude(s), grid(s))


@query("m3_verified")
def m3(s):
    v = PH.verify(dets(s), ground(s), altitude(s), grid(s))
    return v.select("det_id", "confidence_pct", "gate.multiplier", "gate.violation", "gate.reason", "multipath_suspect", "persistence_pings")


@query("x37_evidence_cues", "v_samples", "SELECT DISTINCT concat(survey, side, ping) AS det_id, 'A' AS brain FROM v_samples")
def x37(s):
    from pingframe.functions.text import evidence_cues
    v = PH.verify(dets(s), ground(s), altitude(s), grid(s))
    cue = evidence_cues("analysis", "gate", "brain", "score", "confidence_pct", "verifier_p", "persistence_pings")
    return v.select("det_id", F.get_json_object(cue, "$.brains[0]").alias("brain"))


@query("x27_contacts")
def x27(s):
    v = PH.verify(dets(s), ground(s), altitude(s), grid(s))
    c = build_contacts(v, s.v_nav, altitude(s), grid(s))
    return c.select("id", "cls", "confidence", "lat", "lon", "severity", "priority", "depth_m", F.col("dims.length_m").alias("length_m"), "detected_at")


@query("x20_box_positions", "v_samples v_nav", f"""
WITH {DETS} SELECT det_id, round(CASE WHEN ping1 > ping0 THEN 2 * (ping1 - ping0) * 0.5 ELSE 2.0 END::DOUBLE, 4) AS along_m, 2.0::DOUBLE AS across_m FROM dx WHERE ping1 > ping0""")
def x20(s):
    from pingframe.plans.contacts import geo_boxes
    d = PH.clip_boxes(dets(s), grid(s)).drop("ground_res").where("ping1 > ping0")
    g = geo_boxes(d, s.v_nav, grid(s))
    return g.select("det_id", F.round("along_m", 4).alias("along_m"), "across_m")


@query("w7_contact_ids", "v_samples", f"""
WITH {DETS}, r AS (SELECT survey, det_id, row_number() OVER (PARTITION BY survey ORDER BY 50 + ping0 % 5 DESC, det_id) AS r FROM dx)
SELECT det_id, concat('SN-20231114-', lpad(CAST(r AS STRING), CAST(greatest(4, length(CAST(r AS STRING))) AS INT), '0')) AS id FROM r""")
def w7(s):
    from pingframe.plans.contacts import contact_ids
    d = dets(s).withColumn("confidence_pct", 50.0 + F.col("ping0") % 5)
    return contact_ids(d, s.v_nav).select("det_id", "id")


@query("x16_physics_gate", "v_contacts", """
SELECT id, CASE WHEN NOT highlight THEN 0.5 WHEN NOT shadow OR height_m IS NULL THEN 0.75 WHEN out THEN 0.4 ELSE 1.15 END::DOUBLE AS multiplier,
  (highlight AND shadow AND height_m IS NOT NULL AND out) AS violation FROM (SELECT *, CASE cls WHEN 'ghost_net' THEN height_m > 2.5 WHEN 'container' THEN height_m < 1 OR height_m > 3
  WHEN 'wreck' THEN height_m < 0.5 OR height_m > 15 WHEN 'tire' THEN height_m > 1.2 ELSE false END AS out FROM v_contacts) q""")
def x16(s):
    g = S.physics_gate("cls", "highlight", "shadow", "height_m")
    return s.v_contacts.select("id", g["multiplier"].alias("multiplier"), g["violation"].alias("violation"))


@query("x17_persistence", "v_contacts", """
SELECT id, round(CASE WHEN ping1 - ping0 + 1 < 5 THEN 0.6 ELSE 1 END * least(greatest(0.4 + 0.8 * confidence / 100, 0.4), 1.2), 6) AS factor, ping1 - ping0 + 1 < 5 AS thin FROM v_contacts""")
def x17(s):
    base = F.struct(F.lit(1.0).alias("multiplier"), F.lit(False).alias("violation"), F.lit(None).cast("string").alias("reason"))
    g = S.demote_thin(base, "ping0", "ping1", {**K.SCORING, "min_pings": 5})
    return s.v_contacts.select("id", F.round(g["multiplier"] * S.verifier_factor(F.col("confidence") / 100), 6).alias("factor"),
                               F.coalesce(F.contains(g["reason"], F.lit("thin return")), F.lit(False)).alias("thin"))


@query("j18_height_bands", "v_contacts", """
SELECT cls, count(*) FILTER (CASE cls WHEN 'ghost_net' THEN height_m BETWEEN 0 AND 2.5 WHEN 'container' THEN height_m BETWEEN 1 AND 3 WHEN 'wreck' THEN height_m BETWEEN 0.5 AND 15
  WHEN 'tire' THEN height_m BETWEEN 0 AND 1.2 ELSE true END) AS plausible FROM v_contacts WHERE height_m IS NOT NULL GROUP BY cls""")
def j18(s):
    g = S.physics_gate("cls", F.lit(True), F.lit(True), "height_m")
    return s.v_contacts.where("height_m IS NOT NULL").select("cls", g["violation"].alias("v")).groupBy("cls").agg(F.count_if(~F.col("v")).alias("plausible"))


@query("a8_column_background", "v_samples", f"""
WITH {GROUND}, m AS (SELECT survey, side, col, quantile_cont(v, 0.5) AS med FROM gr GROUP BY ALL), d AS (SELECT survey, side, col, quantile_cont(abs(v - med), 0.5) * 1.4826 AS sg FROM gr JOIN m USING (survey, side, col) GROUP BY ALL)
SELECT survey, side, CAST(col AS INT) AS col, round(med, 6) AS med, round(sg, 6) AS sigma FROM m JOIN d USING (survey, side, col)""")
def a8(s):
    return PH.column_background(ground(s)).select("survey", "side", "col", F.round("med", 6).alias("med"), F.round("sigma", 6).alias("sigma"))


@query("g3_blobs", "v_samples", f"""
WITH RECURSIVE {GROUND}, m AS (SELECT survey, side, col, quantile_cont(v, 0.5) AS med FROM gr GROUP BY ALL), d AS (SELECT survey, side, col, quantile_cont(abs(v - med), 0.5) * 1.4826 AS sg FROM gr JOIN m USING (survey, side, col) GROUP BY ALL),
px AS MATERIALIZED (SELECT survey, side, ping, col FROM gr JOIN m USING (survey, side, col) JOIN d USING (survey, side, col) WHERE v > med + 2 * sg),
r AS (SELECT survey, side, ping AS p0, col AS c0, ping, col FROM px UNION
  SELECT r.survey, r.side, p0, c0, px.ping, px.col FROM r JOIN px ON px.survey = r.survey AND px.side = r.side AND abs(px.ping - r.ping) + abs(px.col - r.col) = 1),
l AS (SELECT survey, side, ping, col, min(CAST(p0 AS BIGINT) * 1000000 + c0) AS root FROM r GROUP BY ALL)
SELECT survey, side, concat_ws('|', survey, side, lpad(CAST(root // 1000000 AS VARCHAR), 12, '0'), lpad(CAST(root % 1000000 AS VARCHAR), 9, '0')) AS blob,
  CAST(min(ping) AS INT) AS ping0, CAST(max(ping) AS INT) AS ping1, CAST(min(col) AS INT) AS col0, CAST(max(col) AS INT) AS col1, count(*) AS area FROM l GROUP BY survey, side, root""")
def g3(s):
    runs, _ = PH.classical_blobs(ground(s), grid(s), 2.0, 0)
    return PH.blob_table(runs).select("survey", "side", "blob", "ping0", "ping1", "col0", "col1", "area")


@query("a13_blob_pixels", "v_samples", f"""
WITH {GROUND}, m AS (SELECT survey, side, col, quantile_cont(v, 0.5) AS med FROM gr GROUP BY ALL), d AS (SELECT survey, side, col, quantile_cont(abs(v - med), 0.5) * 1.4826 AS sg FROM gr JOIN m USING (survey, side, col) GROUP BY ALL)
SELECT survey, side, CAST(count(*) AS BIGINT) AS area, round(max(v), 6) AS peak FROM gr JOIN m USING (survey, side, col) JOIN d USING (survey, side, col) WHERE v > med + 2 * sg GROUP BY survey, side""")
def a13(s):
    """Blob areas add up to the pixels above threshold; the highest blob peak is the highest pixel."""
    runs, _ = PH.classical_blobs(ground(s), grid(s), 2.0, 0)
    return PH.blob_table(runs).groupBy("survey", "side").agg(F.sum("area").alias("area"), F.round(F.max("peak"), 6).alias("peak"))


@query("a14_shadow_fraction", "v_samples", f"""
WITH {GROUND}, {DETS}, m AS (SELECT survey, side, col, quantile_cont(v, 0.5) AS med FROM gr GROUP BY ALL)
SELECT det_id, round(coalesce(count(*) FILTER (v < 0.7 * med) / nullif(count(v), 0)::DOUBLE, 0), 6) AS frac FROM dx d JOIN gr g ON g.survey = d.survey AND g.side = d.side AND g.ping BETWEEN ping0 AND ping1
AND g.col BETWEEN col1 + 1 AND col1 + 48 JOIN m ON m.survey = g.survey AND m.side = g.side AND m.col = g.col GROUP BY det_id""")
def a14(s):
    arrays = PH.background_arrays(PH.column_background(ground(s)), grid(s))
    b = PH.clip_boxes(dets(s), grid(s))
    return PH.shadow_fraction(b, ground(s), arrays).select("det_id", F.round("shadow_frac", 6).alias("frac"))


@query("p4_classical_detector")
def p4(s):
    return PH.classical_detect(ground(s), grid(s), 2.0, 3, open_radius=0, require_shadow=True, min_shadow=0.2)


def labelled_features(s):
    c = s.v_contacts
    num = {"highlight_ratio": F.col("confidence") / 50, "shadow_ratio": F.col("severity") / 100, "shadow_len_m": F.col("length_m"),
           "height_m": F.coalesce("height_m", F.lit(-1.0)), "has_height": F.col("height_m").isNotNull().cast("double"),
           "shadow_linearity": F.col("severity") / 120, "contour_regularity": F.col("width_m") / 6, "texture_entropy_delta": F.col("depth_m") / 50,
           "ping_persistence": (F.col("ping1") - F.col("ping0") + 1).cast("double"), "aspect_ratio": F.col("length_m") / F.col("width_m"),
           "area_px": F.col("length_m") * F.col("width_m"), "range_frac": F.col("col0") / 400.0, "score_raw": F.col("confidence") / 100}
    label = ((F.col("confidence") + F.col("severity")) > 90).cast("int")
    return c.select("id", F.concat("survey", (F.col("seq") % 5).cast("string")).alias("scene"), label.alias("label"),
                    *[num[n].cast("double").alias(n) for n in K.FEATURE_NAMES])


@query("m1_train_verifier")
def m1(s):
    _, metrics = V.train_verifier(labelled_features(s), rounds=5)
    return metrics


@query("m2_score_features", "v_contacts", "SELECT id, true AS is_probability FROM v_contacts")
def m2(s):
    rows = labelled_features(s)
    model, _ = V.train_verifier(rows, rounds=3)
    return V.score_features(model, rows).select("id", F.col("verifier_p").between(0, 1).alias("is_probability"))


@query("w20_scene_split", "v_contacts", "SELECT count(DISTINCT concat(survey, seq % 5)) AS scenes, CAST(5 AS BIGINT) AS val_scenes FROM v_contacts")
def w20(s):
    h = V.holdout_scenes(labelled_features(s), 0.25)
    return h.agg(F.count_distinct("scene").alias("scenes"), F.count_distinct(F.when(F.col("split") == "val", F.col("scene"))).alias("val_scenes"))


_ = (C, BOX, nav)
