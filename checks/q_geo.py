"""Geometry, geodesy, severity, triage and layer queries."""

from pyspark.sql import functions as F

from pingframe import constants as K
from pingframe.functions import geodesy as G
from pingframe.functions import geometry as X
from pingframe.functions import scoring as S
from pingframe.operators import layers as L
from pingframe.operators import summaries

from .registry import query
from .sqltext import dist, ecef, local_xy
from .views import read

r6 = lambda c, n=6: F.round(c, n)


@query("x1_slant_range", "", """
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, round(0.5 * l_tax * 1500.0, 6) AS r,
  round(0.5 * l_quantity * (l_partkey * CAST(1000 AS DOUBLE) / 1e9) * 1480.0, 6) AS jr FROM lineitem""")
def x1(s):
    li = read(s.spark, s.sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                     r6(X.slant_range_from_time("l_tax")).alias("r"),
                     r6(X.slant_range_from_samples("l_quantity", F.col("l_partkey") * F.lit(1000.0), F.lit(1480.0))).alias("jr"))


@query("x2_resolution", "v_contacts", """
SELECT id, round(radians(0.5) * greatest(depth_m * 3, 0), 6) AS along_m, round(0.5 * 1500.0 * 1e-4, 6) AS across_m,
  round(abs(depth_m) * 0.01, 6) AS sv_error FROM v_contacts""")
def x2(s):
    c = X.resolution_cell(F.col("depth_m") * 3)
    return s.v_contacts.select("id", r6(c["along_m"]).alias("along_m"), r6(c["across_m"]).alias("across_m"),
                               r6(X.sound_speed_range_error("depth_m")).alias("sv_error"))


@query("x4_multipath", "v_contacts", """
SELECT id, round(CASE WHEN height_m > 0 THEN height_m * sqrt(3.0) ELSE 0 END, 6) AS expected,
  coalesce(height_m > 0 AND abs(length_m - height_m * sqrt(3.0)) <= 0.15 * height_m * sqrt(3.0), false) AS suspect
FROM v_contacts WHERE height_m IS NOT NULL""")
def x4(s):
    return s.v_contacts.where("height_m IS NOT NULL").select(
        "id", r6(X.multipath_ground_range("height_m")).alias("expected"),
        X.is_multipath_candidate("length_m", "height_m").alias("suspect"))


@query("x5_resolution_curve", "v_contacts", """
WITH q AS (SELECT id, greatest(height_m + 0.3717::DOUBLE, 0) AS a, depth_m + 10.0173::DOUBLE AS s FROM v_contacts),
g AS (SELECT id, i, a, sqrt(greatest(s * s - a * a, 0)) * i / 24 AS ground FROM q, generate_series(0, 24) t(i))
SELECT id, CAST(i AS INT) AS step, round_even(ground, 2) AS ground_range_m, round_even(sqrt(ground * ground + a * a), 2) AS slant_range_m,
  round_even(radians(0.5) * sqrt(ground * ground + a * a), 4) AS along_track_m FROM g""")
def x5(s):
    c = s.wide("v_contacts").select("id", "height_m", "depth_m")
    rows = X.resolution_rows(c, F.col("height_m") + 0.3717, F.col("depth_m") + 10.0173)
    return rows.select("id", "step", "ground_range_m", "slant_range_m", "along_track_m")


@query("x6_shadow_round_trip", "v_contacts", """
WITH q AS (SELECT id, greatest(depth_m / 4, 0.1) AS a, greatest(length_m, 0.1) AS x, height_m + 0.00013::DOUBLE AS h0 FROM v_contacts WHERE height_m IS NOT NULL),
h AS (SELECT *, greatest(least(h0, 0.9 * a), 0) AS h FROM q), e AS (SELECT *, CASE WHEN h <= 0 THEN x ELSE x * a / (a - h) END AS x_end FROM h)
SELECT id, round_even(h, 3) AS height_m, abs(h0 - h) > 1e-9 AS height_clamped, round_even(x, 3) AS shadow_start_m, round_even(x_end, 3) AS shadow_end_m,
  round_even(x_end - x, 3) AS shadow_length_m, round_even(CASE WHEN h <= 0 THEN 0 ELSE a * (x_end - x) / x_end END, 3) AS recovered_height_m,
  round_even(degrees(atan2(a, x)), 2) AS grazing_angle_deg FROM e""")
def x6(s):
    c = s.v_contacts.where("height_m IS NOT NULL")
    rt = X.shadow_round_trip(F.col("depth_m") / 4, F.col("height_m") + 0.00013, "length_m")
    return c.select("id", *[rt[n].alias(n) for n in ("height_m", "height_clamped", "shadow_start_m", "shadow_end_m", "shadow_length_m", "recovered_height_m", "grazing_angle_deg")])


@query("x7_pixel_metres", "v_contacts", """
SELECT id, round((col0 + 0.5) * 1e-1, 6) AS ground_m, round(depth_m / 1e-1 - 0.5, 6) AS col_f,
  round(sqrt(pow((col0 + 0.5) * 1e-1, 2) + pow(depth_m, 2)) / 5e-2 - 0.5, 6) AS slant_sample,
  CASE WHEN pow((ping0 + 0.5) * 5e-2, 2) >= pow(depth_m, 2) THEN
    round(sqrt(pow((ping0 + 0.5) * 5e-2, 2) - pow(depth_m, 2)) / 1e-1 - 0.5, 4) END AS ground_col FROM v_contacts""")
def x7(s):
    return s.v_contacts.select(
        "id", r6(X.ground_range_of_col("col0", 0.1)).alias("ground_m"), r6(X.col_of_ground_range("depth_m", 0.1)).alias("col_f"),
        r6(X.to_slant_sample("col0", "depth_m", 0.1, 0.05)).alias("slant_sample"),
        F.round(X.to_ground_col("ping0", "depth_m", 0.1, 0.05), 4).alias("ground_col"))


@query("x8_sample_to_slant", "v_samples", """
SELECT survey, side, ping, round(max((col + 0.5) * 78125e-5), 6) AS max_slant, round(8.5 / 78125e-5, 6) AS alt_samples FROM v_samples GROUP BY ALL""")
def x8(s):
    return s.v_samples.groupBy("survey", "side", "ping").agg(
        r6(F.max(X.sample_to_slant("col", 0.78125))).alias("max_slant"), r6(X.altitude_samples(F.lit(8.5), 0.78125)).alias("alt_samples"))


@query("x9_waterfall", "v_samples", """
SELECT survey, ping, CASE WHEN side = 'port' THEN 63 - col ELSE 64 + col END AS wf_col, round(v, 6) AS v FROM v_samples""")
def x9(s):
    return s.v_samples.select("survey", "ping", X.waterfall_col("side", "col", F.lit(64), F.lit(64)).alias("wf_col"), r6("v").alias("v"))


@query("x10_mercator", "v_contacts", """
SELECT id, round(degrees((lon * 111000) / 6356752.3142), 6) AS sl_lon,
  round(degrees(2 * atan(exp((lat * 111000) / 6356752.3142)) - pi() / 2), 6) AS sl_lat,
  round(degrees(atan(1.0067642927 * tan(2 * atan(exp((lat * 111000) / 6378388.0)) - pi() / 2))), 6) AS dat_lat FROM v_contacts""")
def x10(s):
    e, n = F.col("lon") * 111000, F.col("lat") * 111000
    a, b = G.sl_mercator_to_lonlat(e, n), G.dat_mercator_to_lonlat(e, n)
    return s.v_contacts.select("id", r6(a["lon"]).alias("sl_lon"), r6(a["lat"]).alias("sl_lat"), r6(b["lat"]).alias("dat_lat"))


@query("x18_offset_position", "v_contacts", f"""
WITH q AS (SELECT id, lat, lon, radians((severity + CASE WHEN side = 'port' THEN 270 ELSE 90 END) % 360) AS az, length_m * 3 AS d,
  1 - {G.WGS84_E2!r} * pow(sin(radians(lat)), 2) AS w2 FROM v_contacts),
m AS (SELECT *, 6378137.0 / sqrt(w2) AS nn, 6378137.0 / sqrt(w2) * {1 - G.WGS84_E2!r} / w2 AS mm, d * cos(az) AS north, d * sin(az) AS east FROM q)
SELECT id, round(lat + degrees(north / mm - east * east * tan(radians(lat)) / (2 * mm * nn)
    - 1.5 * {G.WGS84_E2!r} * sin(radians(lat)) * cos(radians(lat)) * north * north / (w2 * mm * mm)), 6) AS lat2,
  round(lon + degrees((east / (nn * cos(radians(lat)))) * (1 + north * tan(radians(lat)) / nn)), 6) AS lon2 FROM m""")
def x18(s):
    p = G.across_track_position("lat", "lon", "severity", "side", F.col("length_m") * 3)
    return s.v_contacts.select("id", r6(p["lat"]).alias("lat2"), r6(p["lon"]).alias("lon2"))


def _vincenty_sql(rounds=8):
    f, b = G.WGS84_F, G.WGS84_B
    t = f"""SELECT id, atan({1 - f!r} * tan(radians(lat))) AS u1, atan({1 - f!r} * tan(radians(13.2))) AS u2,
      radians(80.6 - lon) AS l0, radians(80.6 - lon) AS lam FROM v_contacts"""
    ang = """sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2"""
    step = """SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM ({t})"""
    step2 = """SELECT *, atan2(ss, cs) AS sig, c1 * c2 * sin(lam) / ss AS sa FROM ({t})"""
    step3 = """SELECT *, 1 - sa * sa AS ca2, cs - 2 * s1 * s2 / (1 - sa * sa) AS cm FROM ({t})"""
    t = f"SELECT *, {ang} FROM ({t})"
    for _ in range(rounds):
        for st in (step, step2, step3):
            t = st.format(t=t)
        t = f"SELECT *, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS cc FROM ({t})"
        t = (f"SELECT id, u1, u2, l0, s1, c1, s2, c2, l0 + (1 - cc) * {f!r} * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM ({t})")
    for st in (step, step2, step3):
        t = st.format(t=t)
    t = f"SELECT *, ca2 * {(G.WGS84_A ** 2 - b ** 2) / b ** 2!r} AS uu FROM ({t})"
    t = f"""SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa,
      uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM ({t})"""
    return f"""SELECT id, round({b!r} * aa * (sig - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1)
      - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM ({t})"""


@query("x19_geodesic", "v_contacts", _vincenty_sql())
def x19(s):
    return s.v_contacts.select("id", F.round(G.geodesic_m("lat", "lon", F.lit(13.2), F.lit(80.6)), 3).alias("metres"))


SEV = """WITH q AS (SELECT *, CASE cls WHEN 'ghost_net' THEN 1.0 WHEN 'container' THEN 0.8 WHEN 'wreck' THEN 0.6
    WHEN 'tire' THEN 0.3 ELSE 0.65 END AS hazard, 1 - exp(-greatest(length_m * width_m, 0) / 40) AS size,
  CASE WHEN height_m IS NULL THEN 0.3 ELSE 1 - exp(-greatest(height_m, 0) / 2) END AS height,
  CASE WHEN depth_m <= 20 THEN 1.0 WHEN depth_m >= 100 THEN 0.2 ELSE 1 - 0.8 * (depth_m - 20) / 80 END AS depth,
  confidence / 100 AS proximity FROM v_contacts)"""


@query("x23_severity", "v_contacts", SEV + """
SELECT id, round(100 * least(greatest((0.4 * hazard + 0.15 * size + 0.1 * height + 0.15 * depth + 0.2 * proximity) / 1.0, 0), 1), 4) AS total,
  round(size, 6) AS size, round(depth, 6) AS depth FROM q""")
def x23(s):
    t = S.severity_terms("cls", F.col("length_m") * F.col("width_m"), "height_m", "depth_m", F.col("confidence") / 100)
    d = s.v_contacts.withColumn("t", t)
    total = 100.0 * sum((w * F.col(f"t.{n}") for n, w in K.SEVERITY_WEIGHTS.items()), F.lit(0.0)) / sum(K.SEVERITY_WEIGHTS.values())
    exact = F.abs(S.severity_total("t") - total) <= 0.0501          # the rounded score is the exact one to 0.1
    return d.select("id", F.when(exact, F.round(total, 4)).alias("total"), r6("t.size").alias("size"), r6("t.depth").alias("depth"))


@query("j19_hazard_lookup", "v_detections", """
SELECT cls, hazard, count(*) AS n FROM (SELECT CASE model WHEN 1 THEN 'odd' ELSE cls END AS cls,
  CASE WHEN model = 1 THEN 0.65 WHEN cls = 'ghost_net' THEN 1.0 WHEN cls = 'container' THEN 0.8 ELSE 0.3 END::DOUBLE AS hazard
  FROM v_detections) q GROUP BY ALL""")
def j19(s):
    cls = F.when(F.col("model") == 1, "odd").otherwise(F.col("cls"))
    t = S.severity_terms("c", 1.0, F.lit(None), F.lit(None), 0.0)
    return s.v_detections.select(cls.alias("c")).withColumn("hazard", t["hazard"]).groupBy(
        F.col("c").alias("cls"), "hazard").agg(F.count("*").alias("n"))


@query("s10_missions", "v_contacts", """
SELECT mission, cls, hazard, count(*) AS n FROM (
  SELECT m.mission, c.cls, coalesce(o.h, CASE c.cls WHEN 'ghost_net' THEN 1.0 WHEN 'container' THEN 0.8 WHEN 'wreck' THEN 0.6
    WHEN 'tire' THEN 0.3 ELSE 0.65 END)::DOUBLE AS hazard
  FROM v_contacts c JOIN (SELECT 'sar' AS mission UNION ALL SELECT 'port') m ON true
  LEFT JOIN (SELECT 'sar' AS mission, 'wreck' AS cls, 0.8 AS h UNION ALL SELECT 'sar', 'tire', 0.05 UNION ALL SELECT 'port', 'container', 1.0) o
  ON o.mission = m.mission AND o.cls = c.cls) q GROUP BY ALL""")
def s10(s):
    from pingframe.sources.layers import mission_hazards
    over = s.spark.createDataFrame([("sar", "wreck", 0.8), ("sar", "tire", 0.05), ("port", "container", 1.0)],
                                   "mission string, cls string, hazard double")
    table = mission_hazards(s.spark, over)
    return s.v_contacts.select("cls").join(F.broadcast(table), "cls").groupBy("mission", "cls", "hazard").agg(F.count("*").alias("n"))


@query("x25_actions", "v_contacts", """
WITH q AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'mpa' WHEN 1 THEN 'shipping_lane' WHEN 2 THEN 'odd' END AS kind, value_m AS dist FROM
  (SELECT *, depth_m * 20 AS value_m FROM v_contacts) x)
SELECT rule, requires, count(*) AS n FROM (SELECT CASE
    WHEN kind IS NOT NULL AND dist < 500 AND cls IN ('ghost_net', 'container') THEN 'near_sensitive_zone'
    WHEN severity >= 75 AND cls = 'ghost_net' THEN 'high_severity' WHEN depth_m > 40 AND cls = 'ghost_net' THEN 'deep'
    WHEN depth_m < 10 AND cls IN ('container', 'wreck') THEN 'shallow' ELSE 'base' END AS rule,
  CASE WHEN cls = 'unknown_anomaly' THEN 'review' ELSE 'recover' END AS requires FROM q) z GROUP BY ALL""")
def x25(s):
    kind = F.when(F.col("seq") % 4 == 0, "mpa").when(F.col("seq") % 4 == 1, "shipping_lane").when(F.col("seq") % 4 == 2, "odd")
    a = S.recommend("cls", "severity", "depth_m", kind, F.col("depth_m") * 20)
    return s.v_contacts.select(a.alias("a")).groupBy(F.col("a.rule").alias("rule"), F.col("a.requires").alias("requires")).agg(
        F.count("*").alias("n"))


@query("j20_action_text", "v_contacts", """
SELECT cls, 'Possible hazardous cargo near protected habitat - notify ' || CASE seq % 3 WHEN 0 THEN 'the marine protected area authority'
  WHEN 1 THEN 'the Directorate General of Shipping' ELSE 'the relevant authority' END AS action, count(*) AS n
FROM v_contacts WHERE cls = 'container' GROUP BY ALL""")
def j20(s):
    kind = F.when(F.col("seq") % 3 == 0, "mpa").when(F.col("seq") % 3 == 1, "shipping_lane").otherwise("odd")
    a = S.recommend("cls", "severity", "depth_m", kind, F.lit(10.0))
    return s.v_contacts.where("cls = 'container'").select("cls", a["action"].alias("action")).groupBy("cls", "action").agg(F.count("*").alias("n"))


@query("x26_position_accuracy", "v_contacts", """
SELECT id, round(2 * 0.05 + CASE WHEN shadow THEN 0 ELSE 5 END + 2 + abs(depth_m) * 0.01, 6) AS accuracy_m FROM v_contacts""")
def x26(s):
    return s.v_contacts.select("id", r6(S.position_accuracy(0.05, "shadow", "depth_m", sv_frac=0.01)).alias("accuracy_m"))


@query("x28_adjusted_confidence", "v_contacts", """
SELECT id, round(least(confidence * 1.15, 100), 6) AS up, round(greatest(confidence * 0.85, 1), 6) AS down FROM v_contacts""")
def x28(s):
    return s.v_contacts.select("id", r6(S.confirmed_confidence("confidence")).alias("up"), r6(S.unconfirmed_confidence("confidence")).alias("down"))


@query("x3_sound_speed_error", "v_contacts", "SELECT id, round(abs(depth_m) * 0.02, 6) AS err FROM v_contacts")
def x3(s):
    return s.v_contacts.select("id", r6(X.sound_speed_range_error("depth_m", 0.02)).alias("err"))


def _seg_dist(c="c", g="g"):
    """distance from contact c to segment g, as nested SQL over planar coordinates ax..by"""
    return """sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))"""


def _layer_sql():
    e0, n0, d0 = local_xy("c.lat", "c.lon", "g.y0", "g.x0")
    e1, n1, d1 = local_xy("c.lat", "c.lon", "g.y1", "g.x1")
    return f"""p AS (SELECT c.id, g.*, c.lat, c.lon, {e0} AS e0, {n0} AS n0, {d0} AS d0, {e1} AS e1, {n1} AS n1, {d1} AS d1
  FROM v_contacts c JOIN v_segments g ON true),
x AS (SELECT *, e0 * d0 / sqrt(e0*e0 + n0*n0) AS ax, n0 * d0 / sqrt(e0*e0 + n0*n0) AS ay,
  e1 * d1 / sqrt(e1*e1 + n1*n1) AS bx, n1 * d1 / sqrt(e1*e1 + n1*n1) AS by_,
  CASE WHEN (y0 > lat) <> (y1 > lat) AND lon < (x0 - x1) * (lat - y1) / nullif(y0 - y1, 0) + x1 THEN 1 ELSE 0 END AS crs FROM p),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM x),
f AS (SELECT id, layer, feature, name, kind, weight, CASE WHEN sum(crs) % 2 = 1 THEN 0 ELSE min({_seg_dist()}) END AS d
  FROM t GROUP BY id, layer, feature, name, kind, weight)"""


@query("j15_nearest_layer", "v_contacts v_segments", f"""
WITH {_layer_sql()}, r AS (SELECT *, weight * exp(-d / 2000) AS c, row_number() OVER (PARTITION BY id
  ORDER BY weight * exp(-d / 2000) DESC, layer, feature) AS r FROM f)
SELECT id, name AS nearest_layer, kind AS nearest_layer_kind, round(c, 6) AS proximity FROM r WHERE r = 1""")
def j15(s):
    return L.nearest_layer(s.v_contacts.select("id", "lat", "lon"), L.square_segments(s.v_segments)).select(
        "id", "nearest_layer", "nearest_layer_kind", F.round("proximity", 6).alias("proximity"))


@query("x22_layer_distance", "v_contacts v_segments", f"""
WITH {_layer_sql()} SELECT id, feature, round(d, 3) AS d FROM f""")
def x22(s):
    near = L.with_layer_distances(s.v_contacts.select("id", "lat", "lon"), L.square_segments(s.v_segments))
    return near.select("id", "feature", F.round("distance_m", 3).alias("d"))


@query("j16_near_layer", "v_contacts v_segments", f"""
WITH {_layer_sql()} SELECT id, cls, d AS distance_m FROM (SELECT id, round_even(min(d), 1) AS d FROM f WHERE layer = 'L1' AND d <= 2000 GROUP BY id) q
JOIN v_contacts USING (id)""")
def j16(s):
    return L.near_layer(s.v_contacts.select("id", "cls", "lat", "lon"), L.square_segments(s.v_segments), "L1").select("id", "cls", "distance_m")


@query("x21_point_in_polygon", "v_contacts v_layers", """
SELECT id, feature FROM v_contacts JOIN v_layers ON lon >= lon0 AND lon < lon0 + size AND lat >= lat0 AND lat < lat0 + size""")
def x21(s):
    return L.inside_features(s.v_contacts.select("id", "lat", "lon"), L.square_segments(s.v_segments)).select("id", "feature")


@query("w6_track_legs", "v_nav", f"""
SELECT survey, ping, round({dist('plat', 'plon', 'lat', 'lon')}, 5) AS leg_m FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM (SELECT * FROM v_nav WHERE ping % 5 <> 2) f WINDOW w AS (PARTITION BY survey ORDER BY ping)) q""")
def w6(s):
    nav = s.v_nav.withColumn("lat", F.when(F.col("ping") % 5 != 2, F.col("lat")))
    return summaries.track_legs(nav).select("survey", "ping", F.round("leg_m", 5).alias("leg_m"))


@query("a18_coverage", "v_nav v_samples", f"""
WITH leg AS (SELECT survey, coalesce({dist('plat', 'plon', 'lat', 'lon')}, 0) AS d, slant_range, sound_velocity, altitude
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM v_nav WINDOW w AS (PARTITION BY survey ORDER BY ping)) q),
t AS (SELECT survey, sum(d) AS track, quantile_cont(slant_range, 0.5) AS rng, quantile_cont(sound_velocity, 0.5) AS sv,
  avg(altitude) AS alt, count(*) AS n, max(slant_range) AS mx FROM leg GROUP BY survey),
sw AS (SELECT survey, sum(w) * 0.78125 AS swath FROM (SELECT survey, side, avg(n) AS w FROM (SELECT survey, side, ping,
  count(*) FILTER (v > 20) AS n FROM v_samples GROUP BY ALL) p GROUP BY ALL) z GROUP BY survey)
SELECT survey, round_even(track / 1000, 3) AS track_length_km, round_even(swath, 1) AS swath_width_m,
  round_even(track * swath / 1e6, 4) AS area_surveyed_sqkm, round_even(rng, 1) AS range_m, round_even(alt, 1) AS altitude_m, n AS n_pings,
  round_even(0.5 * sv * 1e-4, 4) AS across_track_resolution_m, round_even(radians(0.5) * mx, 3) AS along_track_resolution_max_m
FROM t JOIN sw USING (survey)""")
def a18(s):
    ground = s.v_samples.groupBy("survey", "side", "ping").agg(F.count_if(F.col("v") > 20).alias("n_finite"))
    geom = s.v_samples.select("survey", "side").distinct().withColumn("ground_res", F.lit(0.78125))
    return summaries.survey_coverage(s.v_nav, ground, geom).select(
        "survey", "track_length_km", "swath_width_m", "area_surveyed_sqkm", "range_m", "altitude_m", "n_pings",
        "across_track_resolution_m", "along_track_resolution_max_m")


_ = ecef
