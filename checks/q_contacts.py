"""Contact questions, summaries, triage and store queries."""

from pyspark.sql import functions as F

from pingframe.functions import scoring as S
from pingframe.functions import text as T
from pingframe.operators import filters as P
from pingframe.operators import store, summaries
from pingframe.operators.scale import ranked

from .registry import query

BAND = """CASE WHEN severity >= 75 THEN 'critical' WHEN severity >= 50 THEN 'high'
  WHEN severity >= 25 THEN 'medium' ELSE 'low' END"""
PRIO = "CASE WHEN severity >= 75 THEN 'HIGH' WHEN severity >= 50 THEN 'MEDIUM' ELSE 'LOW' END"


@query("flagship_worst_contacts", "v_contacts", f"""
SELECT survey, id, cls, severity, {BAND} AS band, {PRIO} AS priority, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY survey ORDER BY severity DESC, id) AS INT) AS rank FROM v_contacts
  WHERE cls NOT IN ('rock_cluster', 'sand_ripple', 'reef')) q WHERE rank <= 5""")
def flagship(s):
    worst = summaries.work_queue(s.v_contacts.where(P.is_reportable("cls")), 5)
    return worst.select("survey", "id", "cls", "severity", S.severity_band("severity").alias("band"),
                        S.priority("severity").alias("priority"), "rank")


@query("f1_query_contacts", "v_contacts", """
SELECT id, survey, cls, confidence, severity, review FROM v_contacts
WHERE survey = 'S1' AND confidence >= 20 AND severity >= 50 AND review = 'pending' ORDER BY severity DESC, id LIMIT 500""")
def f1(s):
    return P.query_contacts(s.v_contacts, survey="S1", min_conf=20, min_sev=50, review="pending").select(
        "id", "survey", "cls", "confidence", "severity", "review")


@query("f2_dim_filter", "v_contacts", """
SELECT id, height_m, depth_m FROM v_contacts WHERE height_m > 1.5 AND height_m IS NOT NULL
AND depth_m >= 10 AND depth_m <= 30 AND NOT coalesce(length_m < 2, false)""")
def f2(s):
    cond = P.dim_filter("height", lo=1.5) & P.dim_filter("depth", 10, 30, True) & ~P.dim_filter("length", hi=2)
    return s.v_contacts.where(cond).select("id", "height_m", "depth_m")


@query("f3_class_synonyms", "", """
SELECT p_partkey AS part_id, CASE WHEN regexp_matches(p_name, '\\bdrums?\\b') THEN 'cylinder_drum' END AS cls
FROM (SELECT p_partkey, lower(replace(p_name, 'ring', 'drum')) AS p_name FROM part)""")
def f3(s):
    from .views import read
    named = read(s.spark, s.sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.replace("p_name", F.lit("ring"), F.lit("drum")).alias("name"))
    return named.select("part_id", P.find_class("name").alias("cls"))


@query("f4_severity_words", "v_contacts", """
SELECT word, count(*) AS n FROM v_contacts JOIN (SELECT 'critical' AS word, 75 AS t UNION ALL SELECT 'high', 50
  UNION ALL SELECT 'medium', 25) w ON severity >= t WHERE review = 'confirmed' AND survey LIKE '%S%' GROUP BY word""")
def f4(s):
    words = F.explode(F.array(F.lit("critical"), F.lit("high"), F.lit("medium"))).alias("word")
    rows = s.v_contacts.where(P.contact_filter(review="confirmed", survey_like="s")).select("severity", words)
    return rows.where(F.col("severity") >= P.severity_word_threshold("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("f5_console_filter", "v_contacts", """
SELECT id, cls, confidence FROM v_contacts WHERE cls = 'wreck' AND confidence >= 60 AND review = 'confirmed'""")
def f5(s):
    return s.v_contacts.where(P.contact_filter(cls="wreck", min_conf=60, review="confirmed")).select("id", "cls", "confidence")


@query("f6_reportable", "v_detections", """
SELECT cls, count(*) AS n FROM (SELECT CASE model WHEN 1 THEN 'reef' WHEN 2 THEN 'sand_ripple' WHEN 3 THEN 'other'
  ELSE cls END AS cls FROM v_detections) q WHERE cls NOT IN ('reef', 'sand_ripple', 'other') GROUP BY cls""")
def f6(s):
    cls = F.when(F.col("model") == 1, "reef").when(F.col("model") == 2, "sand_ripple").when(
        F.col("model") == 3, "other").otherwise(F.col("cls"))
    return s.v_detections.select(cls.alias("cls")).where(P.is_reportable("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("f7_slice_pings", "v_nav", """
SELECT survey, ping - 10 AS ping, 10 AS ping_offset, lat FROM v_nav WHERE ping >= 10 AND ping < 40""")
def f7(s):
    return P.slice_pings(s.v_nav, 10, 40).select("survey", "ping", "ping_offset", "lat")


@query("f9_routes", "v_contacts", """
SELECT survey, mosaic, normalized, NOT mosaic AS needs_tracking, NOT mosaic AND NOT normalized AS needs_gain, count(*) AS n
FROM (SELECT survey, violation AS mosaic, highlight AS normalized FROM v_contacts) q GROUP BY ALL""")
def f9(s):
    meta = s.v_contacts.select("survey", F.col("violation").alias("ground_range"), F.col("highlight").alias("gain_normalized"))
    r = P.conditioning_route(meta)
    return r.groupBy("survey", F.col("ground_range").alias("mosaic"), F.col("gain_normalized").alias("normalized"),
                     "needs_tracking", "needs_gain").agg(F.count("*").alias("n"))


@query("f10_validity", "v_contacts", """
SELECT CAST((height_m IS NULL OR depth_m IS NULL)::INT + coalesce(height_m <= 0 OR depth_m <= 0, false)::INT
  + coalesce(depth_m <= height_m, false)::INT AS BIGINT) AS faults, count(*) AS n FROM (
  SELECT height_m * 5 AS height_m, depth_m - 1 AS depth_m FROM v_contacts) q GROUP BY 1""")
def f10(s):
    v = P.upload_violations(F.col("height_m") * 5, F.col("depth_m") - 1, "lat", "lon", F.lit("combined"))
    return s.v_contacts.select(F.size(v).cast("bigint").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


@query("f11_structure", "v_samples v_nav", """
WITH t AS (SELECT survey, ping, count(*) FILTER (side = 'port') AS p, count(*) FILTER (side = 'starboard') AS s FROM
  (SELECT DISTINCT survey, side, ping FROM v_samples WHERE col = 0 AND (side = 'starboard' OR v >= 3.5)) d GROUP BY ALL),
n AS (SELECT survey, ping FROM v_nav WHERE altitude IS NOT NULL)
SELECT survey, ping, CASE WHEN n_nav = 0 THEN 'no nav record' WHEN p = 0 AND s = 0 THEN 'no traces'
  ELSE 'ping-count mismatch' END AS fault FROM (
  SELECT coalesce(t.survey, n.survey) AS survey, coalesce(t.ping, n.ping) AS ping, coalesce(p, 0) AS p, coalesce(s, 0) AS s,
    CASE WHEN n.survey IS NULL THEN 0 ELSE 1 END AS n_nav FROM t FULL JOIN n ON t.survey = n.survey AND t.ping = n.ping) q
WHERE n_nav = 0 OR p <> s""")
def f11(s):
    first = s.v_samples.where("col = 0")
    traces = first.where((F.col("side") == "starboard") | (F.col("v") >= 3.5)).select("survey", "side", "ping")
    nav = s.v_nav.where("altitude IS NOT NULL")
    return P.structural_faults(traces, nav).select("survey", "ping", "fault")


@query("f13_decimate", "v_nav", """
SELECT survey, ping FROM v_nav JOIN (SELECT survey, count(*) AS n FROM v_nav GROUP BY survey) c USING (survey)
WHERE ping % CAST(greatest(ceil(n / 16.0), 1) AS INT) = 0""")
def f13(s):
    n = s.v_nav.groupBy("survey").agg(F.count("*").alias("n"))
    return P.decimate(s.v_nav.join(n, "survey"), "n", 16).select("survey", "ping")


@query("f14_score_floor", "v_detections", "SELECT cls, count(*) AS n FROM v_detections WHERE score >= 0.7 GROUP BY cls")
def f14(s):
    return P.score_floor(s.v_detections, 0.7).groupBy("cls").agg(F.count("*").alias("n"))


@query("f15_blob_limits", "v_detections", """
SELECT det_id FROM v_detections WHERE (ping1 - ping0 + 1) * (col1 - col0 + 1) BETWEEN 40 AND 900
AND (ping1 - ping0 + 1) / CAST(col1 - col0 + 1 AS DOUBLE) <= 3
AND (ping1 - ping0 + 1) / CAST(col1 - col0 + 1 AS DOUBLE) >= 1.0 / CAST(3 AS DOUBLE)""")
def f15(s):
    area = (F.col("ping1") - F.col("ping0") + 1) * (F.col("col1") - F.col("col0") + 1)
    return s.v_detections.withColumn("area", area).where(P.blob_filter(40, 900, 3.0)).select("det_id")


@query("f16_nadir_guard", "v_samples", """
SELECT survey, side, count(*) AS n FROM v_samples WHERE v > 130 AND col >= 32 GROUP BY ALL""")
def f16(s):
    return P.anomaly_pixels(s.v_samples, F.lit(130.0)).groupBy("survey", "side").agg(F.count("*").alias("n"))


@query("t1_severity_limit", "v_contacts", "SELECT id, severity FROM v_contacts ORDER BY severity DESC, id LIMIT 500")
def t1(s):
    return P.query_contacts(s.v_contacts).select("id", "severity")


@query("t2_top_by_confidence", "v_contacts", """
SELECT id, cls, confidence, severity FROM v_contacts WHERE cls = 'container' ORDER BY confidence DESC, id LIMIT 10""")
def t2(s):
    return P.top_contacts(s.v_contacts, 10, "confidence", P.contact_filter(cls="container")).select(
        "id", "cls", "confidence", "severity")


@query("t3_verified_order", "v_detections", """
SELECT det_id, score, CAST(row_number() OVER (ORDER BY score DESC, det_id) AS INT) AS rank FROM v_detections""")
def t3(s):
    return ranked(s.v_detections.select("det_id", "score"), [], [F.desc("score"), F.asc("det_id")])


@query("t4_work_queue", "v_contacts", """
SELECT survey, id, severity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY survey ORDER BY severity DESC, id) AS INT)
  AS rank FROM v_contacts) q WHERE rank <= 3""")
def t4(s):
    return summaries.work_queue(s.v_contacts, 3).select("survey", "id", "severity", "rank")


@query("t6_tile_budget", "v_detections", """
SELECT det_id FROM (SELECT *, row_number() OVER (PARTITION BY survey, side, floor(ping0 / 512.0) ORDER BY score DESC, det_id) AS r
  FROM v_detections) q WHERE r <= 20""")
def t6(s):
    d = s.v_detections.withColumn("tile_index", F.floor(F.col("ping0") / 512))
    return P.budget_per_tile(d, 20).select("det_id")


@query("t7_user_sort", "v_contacts", "SELECT id, depth_m FROM v_contacts ORDER BY depth_m, id LIMIT 50")
def t7(s):
    return P.sorted_contacts(s.v_contacts, "depth_m", ascending=True).select("id", "depth_m").limit(50)


@query("t8_spread_sample", "v_contacts", """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS n FROM v_contacts) q
WHERE r % greatest(n // 40, 1) = 0 AND r // greatest(n // 40, 1) < 40""")
def t8(s):
    return P.spread_sample(s.v_contacts, [F.asc("seq")], 40).select("id")


@query("a19_summary_block", "v_contacts", """
SELECT survey, count(*) AS total_detections, count(*) FILTER (confidence >= 70) AS high_confidence, area AS area_surveyed_sqkm,
  round_even(CAST(count(*) AS DOUBLE) / nullif(area, 0), 2) AS debris_density_per_sqkm FROM (
  SELECT *, CAST(CAST(substr(survey, 2) AS INT) * 0.5 AS DOUBLE) AS area FROM v_contacts) q GROUP BY survey, area""")
def a19(s):
    area = s.v_contacts.select("survey").distinct().withColumn(
        "area_surveyed_sqkm", F.substring("survey", 2, 9).cast("int") * F.lit(0.5))
    return summaries.summary_block(s.v_contacts, area)


@query("a20_count_by_class", "v_contacts", "SELECT survey, cls, count(*) AS n FROM v_contacts GROUP BY ALL")
def a20(s):
    return summaries.count_by_class(s.v_contacts, "survey")


@query("a21_band_histogram", "v_contacts", f"""
WITH c AS (SELECT survey, {BAND} AS band, count(*) AS n FROM v_contacts WHERE severity < 90 AND severity >= 25 GROUP BY ALL)
SELECT s.survey, b.band, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT survey FROM c) s
JOIN (SELECT unnest(['critical', 'high', 'medium', 'low']) AS band) b ON true
LEFT JOIN c ON c.survey = s.survey AND c.band = b.band""")
def a21(s):
    return summaries.band_histogram(s.v_contacts.where((F.col("severity") < 90) & (F.col("severity") >= 25)))


@query("a22_physics_tally", "v_contacts", """
SELECT survey, count(*) FILTER (highlight AND shadow) AS both_cues, count(height_m) AS with_height,
  count(*) FILTER (violation) AS violations, round(avg(confidence), 6) AS mean_confidence FROM v_contacts GROUP BY survey""")
def a22(s):
    return summaries.physics_tally(s.v_contacts, "survey").withColumn("mean_confidence", F.round("mean_confidence", 6))


LAYERED = """SELECT *, CASE WHEN seq % 7 = 0 THEN NULL ELSE concat('area_', CAST(seq % 5 AS STRING)) END AS nearest_layer,
  CASE WHEN seq % 11 = 0 THEN NULL ELSE round_even(depth_m * 40, 1) END AS nearest_layer_distance_m FROM v_contacts"""


def layered(s):
    return s.v_contacts.withColumns({
        "nearest_layer": F.when(F.col("seq") % 7 != 0, F.concat(F.lit("area_"), (F.col("seq") % 5).cast("string"))),
        "nearest_layer_distance_m": F.when(F.col("seq") % 11 != 0, F.bround(F.col("depth_m") * 40, 1))})


@query("a23_review_progress", "v_contacts", f"""
WITH l AS ({LAYERED}), near AS (SELECT survey, nearest_layer, nearest_layer_distance_m, id,
  row_number() OVER (PARTITION BY survey ORDER BY nearest_layer_distance_m, id) AS r FROM l
  WHERE nearest_layer IS NOT NULL AND nearest_layer_distance_m IS NOT NULL)
SELECT l.survey, count(*) AS n, count(*) FILTER (review = 'confirmed') AS confirmed, count(*) FILTER (review = 'rejected') AS rejected,
  count(*) FILTER (review = 'pending') AS pending,
  round_even(100.0 * count(*) FILTER (review IN ('confirmed', 'rejected')) / CAST(count(*) AS DOUBLE), 0) AS reviewed_pct,
  any_value(near.nearest_layer) AS closest_layer, any_value(near.nearest_layer_distance_m) AS closest_m, any_value(near.id) AS closest_id
FROM l LEFT JOIN near ON near.survey = l.survey AND near.r = 1 GROUP BY l.survey""")
def a23(s):
    return summaries.review_progress(layered(s))


@query("p6_briefing", "v_contacts", f"""
WITH l AS ({LAYERED})
SELECT survey, count(*) AS n, count(DISTINCT cls) AS n_classes, count(*) FILTER (violation) AS violations FROM l GROUP BY survey""")
def p6(s):
    b = summaries.briefing(layered(s))
    grab = lambda p: F.regexp_extract("briefing", p, 1).cast("bigint")
    return b.select("survey", grab(r"\*\*(\d+) contact").alias("n"), grab(r"across (\d+) class").alias("n_classes"),
                    grab(r"violations:\*\* (\d+) of").alias("violations"))


@query("u3_reviewed_union", "v_contacts v_reviews", """
SELECT id, status AS review, survey || '.jsf' AS source_path FROM v_contacts JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY reviewed_at DESC, seq DESC) AS r
  FROM v_reviews) q WHERE r = 1 AND status IN ('confirmed', 'rejected')) x ON id = contact_id""")
def u3(s):
    surveys = s.v_contacts.select("survey").distinct().withColumn("source_path", F.concat("survey", F.lit(".jsf")))
    return store.reviewed_with_source(s.v_contacts, surveys, s.v_reviews).select("id", "review", "source_path")


@query("u7_distinct_classes", "v_contacts", "SELECT DISTINCT cls FROM v_contacts")
def u7(s):
    return summaries.distinct_classes(s.v_contacts)


@query("x24_bands", "v_contacts", f"SELECT id, {BAND} AS band, {PRIO} AS priority FROM v_contacts")
def x24(s):
    return s.v_contacts.select("id", S.severity_band("severity").alias("band"), S.priority("severity").alias("priority"))


@query("x35_answer_lines", "v_contacts", """
SELECT id, concat(id, ': ', cls, ' (severity ', CAST(severity AS STRING), ', confidence ', CAST(round(confidence, 1) AS STRING), '%)') AS line,
  concat('length 2.5-', CAST(9 AS STRING), ' m') AS note FROM v_contacts WHERE cls = 'tire' AND length_m > 2.5 AND length_m < 9""")
def x35(s):
    top = s.v_contacts.where(P.contact_filter(cls="tire") & P.dim_filter("length", 2.5, 9.0))
    return top.select("id", T.answer_line("id", "cls", "severity", F.round("confidence", 1)).alias("line"), F.lit(T.describe_range("length", 2.5, 9.0)).alias("note"))


@query("w13_latest_status", "v_reviews", """
SELECT contact_id, status, reviewed_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY contact_id
  ORDER BY reviewed_at DESC, seq DESC) AS r FROM v_reviews) q WHERE r = 1""")
def w13(s):
    return store.latest_status(s.v_reviews).select("contact_id", "status", "reviewed_at", "seq")


@query("j26_review_state", "v_contacts v_reviews", """
SELECT id, coalesce(status, 'pending') AS review, actor AS review_actor FROM v_contacts LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY reviewed_at DESC, seq DESC) AS r
  FROM v_reviews) q WHERE r = 1) x ON id = contact_id""")
def j26(s):
    return store.with_log_state(s.v_contacts, s.v_reviews).select("id", "review", "review_actor")


@query("j13_reviewed_source", "v_contacts v_reviews", """
SELECT id, c.survey, status AS review, reviewed_at AS review_at, source_path FROM v_contacts c JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY reviewed_at DESC, seq DESC) AS r
  FROM v_reviews) q WHERE r = 1 AND status IN ('confirmed', 'rejected')) x ON id = contact_id
LEFT JOIN (SELECT DISTINCT survey, concat('/data/', survey, '.jsf') AS source_path FROM v_contacts WHERE survey <> 'S3') s
ON s.survey = c.survey""")
def j13(s):
    surveys = s.v_contacts.where("survey <> 'S3'").select("survey").distinct().withColumn(
        "source_path", F.concat(F.lit("/data/"), "survey", F.lit(".jsf")))
    return store.reviewed_with_source(s.v_contacts, surveys, s.v_reviews).select(
        "id", "survey", "review", "review_at", "source_path")


@query("s15_upsert", "v_contacts", """
SELECT id, survey, CASE WHEN seq % 3 = 0 THEN severity + 1 ELSE severity END AS severity FROM v_contacts""")
def s15(s):
    c = s.v_contacts.select("id", "survey", "severity", "seq")
    batch = c.where("seq % 3 = 0").withColumn("severity", F.col("severity") + 1)
    stale = batch.withColumns({"severity": F.lit(-1.0), "seq": F.col("seq") - 1})
    return store.upserted(c, batch.unionByName(stale)).select("id", "survey", "severity")


@query("s16_delete_survey", "v_contacts", "SELECT survey, count(*) AS n FROM v_contacts WHERE survey <> 'S2' GROUP BY survey")
def s16(s):
    return store.without_survey(s.v_contacts, "S2").groupBy("survey").agg(F.count("*").alias("n"))


@query("s17_survey_catalogue", "v_contacts", """
SELECT survey, max(seq) AS processed_at FROM v_contacts GROUP BY survey""")
def s17(s):
    runs = s.v_contacts.select("survey", F.col("seq").alias("processed_at"), F.col("id").alias("run"))
    return store.survey_catalogue(runs).select("survey", "processed_at")


@query("s20_json_column", "", """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events""")
def s20(s):
    from pingframe.sinks.reports import decode_contact_json

    from .views import read
    ev = read(s.spark, s.sf_dir, "events").select("event_id", F.col("props").alias("json"))
    return decode_contact_json(ev, "k BIGINT").select("event_id", F.col("doc.k").alias("k"))
