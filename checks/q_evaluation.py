"""Matching, metric and calibration queries."""

from pyspark.sql import functions as F

from pingframe.functions import scoring as S
from pingframe.operators import evaluation as E
from pingframe.session import written

from .registry import query
from .sqltext import iou

CAND = f"""cand AS (SELECT a.det_id, b.truth_id, {iou()} AS iou FROM v_detections a JOIN v_truth b
  ON a.survey = b.survey AND a.side = b.side AND a.cls = b.cls AND a.ping0 <= b.ping1 AND b.ping0 <= a.ping1
  AND a.col0 <= b.col1 AND b.col0 <= a.col1 WHERE {iou()} >= 0.1)"""
LAB = """lab AS (SELECT survey AS config, det_id, bround1 AS confidence, det_id IN (SELECT det_id FROM cand) AS is_tp FROM
  (SELECT *, round_even(score * 100, 1) AS bround1 FROM v_detections) d),
tc AS (SELECT survey AS config, count(*) AS n_truth, count(*) / CAST(1000 AS DOUBLE) AS area_km2 FROM v_truth GROUP BY survey)"""


def labels(s):
    d = E.any_match(s.wide("v_detections"), s.v_truth, 0.1)
    lab = d.select(F.col("survey").alias("config"), "det_id", F.bround(F.col("score") * 100, 1).alias("confidence"),
                   F.col("correct").alias("is_tp"))
    tc = s.v_truth.groupBy(F.col("survey").alias("config")).agg(
        F.count("*").alias("n_truth"), (F.count("*") / F.lit(1000.0)).alias("area_km2"))
    return lab, tc


@query("j10_match_candidates", "v_detections v_truth", f"WITH {CAND} SELECT det_id, truth_id, round(iou, 9) AS iou FROM cand")
def j10(s):
    return E.match_candidates(s.wide("v_detections"), s.v_truth, 0.1).select("det_id", "truth_id", F.round("iou", 9).alias("iou"))


@query("j11_any_match", "v_detections v_truth", f"""
WITH {CAND} SELECT det_id, det_id IN (SELECT det_id FROM cand) AS correct FROM v_detections""")
def j11(s):
    return E.any_match(s.wide("v_detections"), s.v_truth, 0.1).select("det_id", "correct")


def _ablated(s):
    score = F.col("score")
    dets = s.wide("v_detections")
    rows = E.ablation(dets, {
        "raw": S.confidence_pct("score", 1.0), "gate": S.confidence_pct("score", F.when(F.col("model") > 3, 0.5).otherwise(1.15)),
        "verifier": F.bround(score * 80, 1), "full": S.confidence_pct("score", F.when(F.col("model") > 4, 0.3).otherwise(1.0))})
    return E.match_greedy(rows.drop("brain", "model", "score"), E.match_candidates(dets, s.v_truth, 0.1, listed=False))


@query("g5_greedy_matching")
def g5(s):
    return _ablated(s).select("config", "det_id", "truth_id", "confidence", "is_tp")


@query("g5_one_to_one", "v_detections v_truth", f"""
WITH {CAND} SELECT c.config, count(*) AS n, 0 AS claimed_twice FROM v_detections
JOIN (SELECT unnest(['raw', 'gate', 'verifier', 'full']) AS config) c ON true GROUP BY c.config""")
def g5_check(s):
    m = written(_ablated(s).select("config", "truth_id"))
    twice = m.where("truth_id IS NOT NULL").groupBy("config", "truth_id").count().where("count > 1")
    bad = twice.groupBy("config").agg(F.count("*").cast("int").alias("claimed_twice"))
    return m.groupBy("config").agg(F.count("*").alias("n")).join(bad, "config", "left").na.fill(0)


@query("u5_ablation_counts", "v_detections", """
SELECT config, count(*) AS n, round(sum(CASE config WHEN 'raw' THEN score ELSE score / 2 END), 4) AS total FROM v_detections
JOIN (SELECT unnest(['raw', 'half']) AS config) c ON true GROUP BY config""")
def u5(s):
    r = E.ablation(s.wide("v_detections"), {"raw": F.col("score"), "half": F.col("score") / 2})
    return r.groupBy("config").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("a27_point_metrics", "v_detections v_truth", f"""
WITH {CAND}, {LAB}, a AS (SELECT config, count(*) AS n_detections, count(*) FILTER (confidence >= 70 AND is_tp) AS tp,
  count(*) FILTER (confidence >= 70 AND NOT is_tp) AS fp FROM lab GROUP BY config)
SELECT config, n_detections, tp, fp, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision,
  round(coalesce(tp / nullif(n_truth, 0)::DOUBLE, 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(tp + fp + n_truth, 0)::DOUBLE, 0), 9) AS f1, round(fp / area_km2, 6) AS fp_per_km2
FROM a LEFT JOIN tc USING (config)""")
def a27(s):
    m = E.point_metrics(*labels(s), floor=70.0)
    return m.select("config", "n_detections", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    F.round("fp_per_km2", 6).alias("fp_per_km2"))


@query("w9_pr_auc", "v_detections v_truth", f"""
WITH {CAND}, {LAB}, r AS (SELECT *, row_number() OVER w AS k, sum(is_tp::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM lab
  WINDOW w AS (PARTITION BY config ORDER BY confidence DESC, det_id))
SELECT config, round(coalesce(sum(CASE WHEN is_tp THEN cum / k::DOUBLE ELSE 0 END) / any_value(n_truth), 0), 9) AS pr_auc
FROM r LEFT JOIN tc USING (config) GROUP BY config""")
def w9(s):
    return E.pr_auc(*labels(s)).withColumn("pr_auc", F.round("pr_auc", 9))


@query("w10_best_floor", "v_detections v_truth", f"""
WITH {CAND}, {LAB}, p AS (SELECT config, confidence, count(*) AS n, sum(is_tp::INT) AS t FROM lab GROUP BY ALL),
c AS (SELECT config, confidence, sum(n) OVER w AS kept, sum(t) OVER w AS tp FROM p WINDOW w AS (PARTITION BY config ORDER BY confidence DESC)),
f AS (SELECT config, confidence, 2 * tp / (kept + n_truth)::DOUBLE AS f1 FROM c JOIN tc USING (config))
SELECT config, round(f1, 9) AS best_f1, confidence AS floor FROM (SELECT *, row_number() OVER (PARTITION BY config
  ORDER BY round(f1, 12) DESC, confidence DESC) AS r FROM f) q WHERE r = 1""")
def w10(s):
    return E.best_floor(*labels(s)).withColumn("best_f1", F.round("best_f1", 9))


@query("a28_select_setting", "v_detections", """
WITH c AS (SELECT cls AS variant, CAST(model AS DOUBLE) AS k, round(avg(score), 6) AS f1, max(score) AS cut FROM v_detections GROUP BY ALL),
e AS (SELECT variant, max(f1) FILTER (k BETWEEN 2 AND 6) AS interior, max(f1) FILTER (k IN (1, 7)) AS endpoint FROM c GROUP BY variant)
SELECT variant, k, f1, round(cut, 6) AS cut, CASE WHEN k NOT IN (1, 7) THEN NULL WHEN endpoint - interior <= 0.02 THEN 'plateau' ELSE 'widen the grid' END AS note
FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f1 DESC, k) AS r FROM c) q JOIN e USING (variant) WHERE r = 1""")
def a28(s):
    curve = s.wide("v_detections").groupBy(F.col("cls").alias("variant"), F.col("model").cast("double").alias("k")).agg(
        F.round(F.avg("score"), 6).alias("f1"), F.max("score").alias("cut"))
    return E.select_setting(curve).withColumn("cut", F.round("cut", 6))


@query("a29_clutter_sweep", "v_detections v_truth", f"""
WITH {CAND}, d AS (SELECT det_id, side AS mode, model AS rank, score * 100 AS confidence, det_id IN (SELECT det_id FROM cand) AS is_tp FROM v_detections)
SELECT mode, level, count(*) FILTER (confidence >= 60 AND is_tp) AS tp, count(*) FILTER (confidence >= 60 AND NOT is_tp) AS fp
FROM d JOIN (SELECT unnest([0, 2, 4, 7]) AS level) l ON rank <= level GROUP BY ALL""")
def a29(s):
    d = E.any_match(s.wide("v_detections"), s.v_truth, 0.1).select(
        "det_id", F.col("side").alias("mode"), F.col("model").alias("decoy_rank"), (F.col("score") * 100).alias("confidence"),
        F.col("correct").alias("is_tp"))
    tc = s.v_truth.groupBy(F.col("side").alias("mode")).agg(F.count("*").alias("n_truth")).withColumn("area_km2", F.lit(1.0))
    lv = E.at_clutter_levels(d, [0, 2, 4, 7])
    return E.point_metrics(lv, tc.withColumn("level", F.explode(F.array(*[F.lit(v) for v in (0, 2, 4, 7)]))), 60.0, ("mode", "level")).select(
        "mode", "level", "tp", "fp")


SC = """sc AS (SELECT least(confidence / 100, 1) AS score, severity >= 50 AS correct, least(greatest(ceil(least(confidence / 100, 1) * 10) - 1, 0), 9)::INT AS b FROM v_contacts WHERE confidence > 0)"""


def scored(s):
    return s.v_contacts.where("confidence > 0").select(F.least(F.col("confidence") / 100, F.lit(1.0)).alias("score"), (F.col("severity") >= 50).alias("correct"))


EDGES = """sc AS (SELECT score, correct, bin FROM (SELECT least(confidence / 100, 1) AS score, severity >= 50 AS correct FROM v_contacts WHERE confidence > 0) q
  JOIN (SELECT i::INT AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM generate_series(0, 9) t(i)) e ON score > lo AND score <= hi)"""


@query("a24_calibration_error", "v_contacts", f"""
WITH {EDGES} SELECT round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM (SELECT bin, count(*) AS n, avg(correct::INT) AS a, avg(score) AS c FROM sc GROUP BY bin) g""")
def a24(s):
    return E.expected_calibration_error(scored(s)).withColumn("ece", F.round("ece", 9))


@query("a25_reliability", "v_contacts", f"""
WITH {EDGES} SELECT bin, round((bin + 0.5::DOUBLE) / 10, 6) AS centre, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(score), 9) AS mean_score FROM sc GROUP BY bin""")
def a25(s):
    return E.reliability(scored(s)).select("bin", F.round("centre", 6).alias("centre"), "n", F.round("accuracy", 9).alias("accuracy"),
                                           F.round("mean_score", 9).alias("mean_score"))


@query("a26_nll", "v_contacts", """
WITH z AS (SELECT ln(q / (1 - q)) AS z, (severity >= 50)::INT AS c FROM (SELECT greatest(least(least(confidence / 100, 1), 1 - 1e-6), 1e-6) AS q, severity FROM v_contacts WHERE confidence > 0) x),
p AS (SELECT t AS temperature, c, greatest(least(1 / (1 + exp(-z / t)), 1 - 1e-6), 1e-6) AS p FROM z JOIN (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS t) g ON true)
SELECT temperature, round(avg(-(c * ln(p) + (1 - c) * ln(1 - p))), 6) AS nll FROM p GROUP BY temperature""")
def a26(s):
    return E.nll_by_temperature(scored(s), [0.5, 1.0, 2.0]).withColumn("nll", F.round("nll", 6))


@query("g9_fit_temperature")
def g9(s):
    sc = scored(s)
    t = E.fit_temperature(sc)
    return sc.agg(F.count("*").alias("n")).withColumn("temperature", F.lit(t))


@query("x15_temperature_scaling", "v_detections", """
SELECT det_id, round(100 * least(1 / (1 + exp(-ln(q / (1 - q)) / 1.05)) * 1.15, 1), 4) AS pct FROM (SELECT det_id, greatest(least(score, 1 - 1e-6), 1e-6) AS q FROM v_detections) x""")
def x15(s):
    from pingframe.functions.columns import clamp
    raw = 100.0 * clamp(S.calibrated("score") * 1.15, 0.0, 1.0)
    same = F.abs(S.confidence_pct("score", 1.15) - raw) <= 0.0501
    return s.wide("v_detections").select("det_id", F.when(same, F.round(raw, 4)).alias("pct"))


IMG = """img AS (SELECT *, survey AS image, CASE WHEN model = 7 THEN 'unknown_anomaly' WHEN model = 6 THEN 'wreck' ELSE cls END AS c2, score * 100 AS confidence FROM v_detections)"""


def img(s):
    c2 = F.when(F.col("model") == 7, "unknown_anomaly").when(F.col("model") == 6, "wreck").otherwise(F.col("cls"))
    return s.wide("v_detections").withColumns({"image": F.col("survey"), "confidence": F.col("score") * 100}).withColumn("cls", c2)


@query("a30_image_behaviour", "v_detections", f"""
WITH {IMG} SELECT image, count(*) AS n_raw, count(*) FILTER (c2 <> 'unknown_anomaly') AS n_brain_a, count(*) FILTER (c2 = 'unknown_anomaly') AS n_anomaly,
  count(*) FILTER (confidence >= 80) AS n_above_floor, round(max(score), 6) AS top_score FROM img GROUP BY image""")
def a30(s):
    return E.image_behaviour(img(s), 80.0).select("image", "n_raw", "n_brain_a", "n_anomaly", "n_above_floor", F.round("top_score", 6).alias("top_score"))


@query("a30_corpus_report", "v_detections", f"""
WITH {IMG}, i AS (SELECT image, count(*) AS n_raw, count(*) FILTER (c2 <> 'unknown_anomaly') AS a, count(*) FILTER (confidence >= 80) AS f, max(score) AS t,
  bool_or(c2 = 'wreck') AS w FROM img GROUP BY image)
SELECT count(*) AS images, CAST(sum(n_raw) AS BIGINT) AS raw, round(sum(n_raw) / count(*)::DOUBLE, 6) AS raw_per_image, round(100 * sum(a) / sum(n_raw)::DOUBLE, 6) AS brain_a_pct,
  CAST(sum(f) AS BIGINT) AS above_floor, round(avg(t), 6) AS mean_top_score, count(*) FILTER (w) AS ships_reaching FROM i""")
def a30c(s):
    d = img(s)
    r = E.corpus_report(E.image_behaviour(d, 80.0), d.select("image").distinct().withColumn("kind", F.lit("ship")))
    return r.select("images", "raw", *[F.round(c, 6).alias(c) for c in ("raw_per_image", "brain_a_pct")], "above_floor",
                    F.round("mean_top_score", 6).alias("mean_top_score"), "ships_reaching")


@query("a31_acceptance_gates", "v_detections", f"""
WITH {IMG}, m AS (SELECT avg(score) FILTER (model <= 3) AS b, avg(score) FILTER (model > 3) AS c FROM img WHERE side = 'port'),
t AS (SELECT CASE WHEN model <= 3 THEN 'b' ELSE 'c' END AS m, image, max(ROW(confidence, c2)) AS top FROM img GROUP BY ALL),
r AS (SELECT avg((top[2] = 'tire')::INT) FILTER (m = 'b') AS rb, avg((top[2] = 'tire')::INT) FILTER (m = 'c') AS rc FROM t)
SELECT round(b - c, 6) AS drop, CASE WHEN b - c <= 0.03 THEN 'PASS' ELSE 'FAIL' END AS gate_regression, round(rb, 6) AS reach_baseline,
  round(rc, 6) AS reach_candidate, CASE WHEN rc > rb THEN 'PASS' ELSE 'FAIL' END AS gate_reach FROM m, r""")
def a31(s):
    d = img(s).withColumn("m", F.when(F.col("model") <= 3, "baseline").otherwise("candidate"))
    met = d.where("side = 'port'").groupBy(F.lit("synth").alias("val_set"), F.col("m").alias("model")).agg(F.avg("score").alias("map50"))
    reach = E.class_reach(d.drop("model").withColumnRenamed("m", "model"), ["tire"], ("model",))
    g = E.acceptance_gates(met, reach)
    return g.select(F.round("drop", 6).alias("drop"), "gate_regression", F.round("reach_baseline", 6).alias("reach_baseline"),
                    F.round("reach_candidate", 6).alias("reach_candidate"), "gate_reach")


@query("a32_class_reach", "v_detections", f"""
WITH {IMG}, t AS (SELECT side, image, max(ROW(confidence, c2)) AS top FROM img GROUP BY ALL)
SELECT side, count(*) FILTER (top[2] = 'wreck') AS hits, count(*) AS total FROM t GROUP BY side""")
def a32(s):
    return E.class_reach(img(s), ["wreck"], ("side",)).select("side", "hits", "total")


@query("a34_composition", "v_detections", """
WITH p AS (SELECT cls AS source, side AS split, count(*) AS n FROM v_detections GROUP BY ALL)
SELECT source, split, n, round(100 * n / (sum(n) OVER (PARTITION BY split))::DOUBLE, 6) AS share_pct FROM p""")
def a34(s):
    return E.composition(s.wide("v_detections").select(F.col("cls").alias("source"), F.col("side").alias("split"))).withColumn("share_pct", F.round("share_pct", 6))


@query("a38_error_fractions", "v_samples", """
WITH q AS (SELECT survey AS corpus, quantile_cont(v, 0.995) AS t FROM v_samples GROUP BY survey)
SELECT corpus, round(any_value(t), 6) AS threshold, round(avg((v > t)::INT), 9) AS share_above FROM v_samples JOIN q ON corpus = survey GROUP BY corpus""")
def a38(s):
    r = E.error_fractions(s.v_samples.withColumnRenamed("survey", "corpus"))
    return r.select("corpus", F.round("threshold", 6).alias("threshold"), F.round("share_above", 9).alias("share_above"))


@query("a39_accuracy_auc", "v_contacts", """
WITH q AS (SELECT survey, severity AS s, (confidence >= 40)::INT AS y FROM v_contacts), r AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY survey, s) - 1) / 2.0) AS rk
  FROM q WINDOW w AS (PARTITION BY survey ORDER BY s))
SELECT survey, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * sum(1 - y))::DOUBLE, 9) AS auc, round(avg(((s >= 50)::INT = y)::INT), 9) AS accuracy FROM r GROUP BY survey""")
def a39(s):
    q = s.v_contacts.select("survey", F.col("severity").alias("score"), (F.col("confidence") >= 40).cast("int").alias("label"))
    a = E.roc_auc(q, keys=("survey",))
    return a.join(E.accuracy(q, 50.0, keys=("survey",)), "survey").select("survey", F.round("auc", 9).alias("auc"), F.round("accuracy", 9).alias("accuracy"))


@query("j24_taxonomy", "v_contacts", """
WITH want AS (SELECT * FROM (VALUES (0, 'ghost_net'), (1, 'wreck'), (2, 'aircraft'), (3, 'pipeline'), (4, 'cylinder_drum'), (5, 'tire'), (6, 'container'),
  (7, 'human_body'), (8, 'mine_like'), (9, 'rock_cluster'), (10, 'sand_ripple'), (11, 'reef')) t(class_id, expected)),
have AS (SELECT DISTINCT survey AS source, CAST(CASE cls WHEN 'ghost_net' THEN 0 WHEN 'wreck' THEN 1 WHEN 'tire' THEN 5 WHEN 'container' THEN 3 ELSE 12 END AS INT) AS class_id, cls FROM v_contacts),
f AS (SELECT source, class_id, expected FROM (SELECT DISTINCT source FROM have) s, want)
SELECT coalesce(f.source, have.source) AS source, coalesce(f.class_id, have.class_id) AS class_id, expected, cls FROM f FULL JOIN have
ON f.source = have.source AND f.class_id = have.class_id WHERE expected IS DISTINCT FROM cls""")
def j24(s):
    cid = F.when(F.col("cls") == "ghost_net", 0).when(F.col("cls") == "wreck", 1).when(F.col("cls") == "tire", 5).when(F.col("cls") == "container", 3).otherwise(12)
    have = s.v_contacts.select(F.col("survey").alias("source"), cid.alias("class_id"), "cls").distinct()
    return E.taxonomy_mismatches(have).select("source", "class_id", "expected", "cls")
