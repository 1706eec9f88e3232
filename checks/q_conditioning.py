"""Conditioning queries: the oracle works on the long pixel view, the library on ping rows."""

from pyspark.sql import functions as F

from pingframe.operators import conditioning as C
from pingframe.operators import filters as P
from pingframe.operators.scale import framed, interpolate_gaps
from pingframe.plans.conditioning import condition

from .registry import query

KEYS = ["survey", "side", "ping"]
RES = "78125e-5"


def traces(s):
    """Ping rows straight from the vectors (one row per ping-side; spread, as the table is one row group)."""
    from .views import read
    e = read(s.spark, s.sf_dir, "embeddings").repartition(s.spark.sparkContext.defaultParallelism)
    vid = F.col("vec_id")
    v = F.transform("embedding", lambda x, i: F.when(i < 9 + vid % 4, 4.0 * (1.0 + x.cast("double"))).otherwise(
        (100.0 * (1.0 + 2.0 * x.cast("double"))) * (1.5 - i / 128.0)))
    return e.select(F.concat(F.lit("S"), (vid % 5).cast("string")).alias("survey"),
                    F.when(F.floor(vid / 5) % 2 == 0, "port").otherwise("starboard").alias("side"),
                    F.floor(vid / 10).cast("int").alias("ping"), v.alias("samples"))


def nav(s):
    return s.v_nav.withColumn("altitude", F.coalesce("altitude", F.lit(8.0)))


def long_rows(df, column="cols", digits=6):
    return df.select(*KEYS, F.posexplode(column).alias("col", "v")).select(*KEYS, "col", F.round("v", digits).alias("v"))


def shape(s):
    return C.survey_geometry(traces(s), s.v_nav).withColumn("n_cols", F.col("n_samples"))


def image(s):
    """The pixel view as an image with holes, for the 2-D filters."""
    return traces(s).select(*KEYS, F.transform("samples", lambda v, i: F.when((i + F.col("ping")) % 11 != 3, v)).alias("cols"))


IMAGE = "im AS MATERIALIZED (SELECT survey, side, ping, col, CASE WHEN (col + ping) % 11 <> 3 THEN v END AS v FROM v_samples)"


@query("a1_slant_resolution", "v_samples v_nav", """
SELECT survey, side, CAST(64 AS INT) AS n_samples, round(quantile_cont(slant_range, 0.5) / 64, 9) AS slant_res
FROM v_nav JOIN (SELECT DISTINCT survey, side FROM v_samples) USING (survey) GROUP BY survey, side""")
def a1(s):
    return C.survey_geometry(traces(s), s.v_nav).select("survey", "side", "n_samples", F.round("slant_res", 9).alias("slant_res"))


@query("a2_modal_width", "v_samples", """
WITH c AS (SELECT survey, side, ping, v, col, 64 - (ping % 3 = 0)::INT * 5 AS n FROM v_samples), m AS (SELECT survey, side, mode(n) AS w FROM
  (SELECT DISTINCT survey, side, ping, n FROM c) d GROUP BY ALL),
g AS (SELECT c.survey, c.side, ping, w, c.n, sum(CASE WHEN col < least(w, c.n) THEN v ELSE 0 END) AS total FROM c JOIN m ON c.survey = m.survey AND c.side = m.side GROUP BY ALL)
SELECT survey, side, ping, CAST(w AS INT) AS width, round(total, 6) AS total FROM g""")
def a2(s):
    cut = traces(s).select(*KEYS, F.when(F.col("ping") % 3 == 0, F.slice("samples", 1, 59)).otherwise(F.col("samples")).alias("samples"))
    geom = C.survey_geometry(cut, s.v_nav).select("survey", "side", "n_samples")
    fit = C.salted_join(cut, geom, C.SIDE, "ping").withColumn("samples", C.fit_width("samples", "n_samples"))
    return fit.select(*KEYS, F.size("samples").alias("width"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


SMOOTH = """sm AS (SELECT *, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3 AS s FROM v_samples WINDOW w AS (PARTITION BY survey, side, ping ORDER BY col)),
nz AS (SELECT survey, side, ping, median(s) AS noise FROM sm WHERE col < 4 GROUP BY ALL),
fl AS (SELECT survey, side, greatest(median(noise) * 0.1, 1e-6) AS fl FROM nz GROUP BY ALL),
ab AS (SELECT sm.survey, sm.side, sm.ping, col, s > greatest(noise, fl) * 4 AS a FROM sm JOIN nz USING (survey, side, ping) JOIN fl USING (survey, side)),
rn AS (SELECT *, a AND coalesce(lead(a, 1) OVER w, a) AND coalesce(lead(a, 2) OVER w, coalesce(lead(a, 1) OVER w, a)) AS r FROM ab
  WINDOW w AS (PARTITION BY survey, side, ping ORDER BY col)),
fr AS (SELECT survey, side, ping, coalesce(min(col) FILTER (r), -1) AS first FROM rn GROUP BY ALL)"""


@query("w2_first_return", "v_samples", f"WITH {SMOOTH} SELECT survey, side, ping, first FROM fr")
def w2(s):
    return C.first_returns(traces(s)).select(*KEYS, "first")


@query("w1_water_noise", "v_samples", f"WITH {SMOOTH} SELECT survey, side, ping, round(noise, 6) AS noise FROM nz")
def w1(s):
    return traces(s).select(*KEYS, F.round(C.water_noise("samples"), 6).alias("noise"))


def _fill(t, x, out):
    """Linear gap fill of column x over ping as SQL CTEs (t has survey, ping)."""
    return f"""{out}_k AS (SELECT survey, ping, {x} AS x FROM {t} WHERE {x} IS NOT NULL),
{out}_b AS (SELECT t.*, (SELECT max(k.ping) FROM {out}_k k WHERE k.survey = t.survey AND k.ping <= t.ping) AS pp,
  (SELECT min(k.ping) FROM {out}_k k WHERE k.survey = t.survey AND k.ping >= t.ping) AS np FROM {t} t),
{out} AS (SELECT b.*, CASE WHEN a.x IS NULL THEN c.x WHEN c.x IS NULL THEN a.x WHEN pp = np THEN a.x
  ELSE a.x + (c.x - a.x) * (b.ping - pp) / (np - pp)::DOUBLE END AS filled FROM {out}_b b
  LEFT JOIN {out}_k a ON a.survey = b.survey AND a.ping = b.pp LEFT JOIN {out}_k c ON c.survey = b.survey AND c.ping = b.np)"""


@query("w4_gap_fill", "v_nav", f"""
WITH t AS (SELECT survey, ping, CASE WHEN ping % 7 IN (0, 1, 6) THEN NULL ELSE altitude END AS a FROM v_nav), {_fill('t', 'a', 'f')}
SELECT survey, ping, round(filled, 6) AS v FROM f""")
def w4(s):
    t = s.v_nav.withColumn("a", F.when(~(F.col("ping") % 7).isin(0, 1, 6), F.col("altitude")))
    return interpolate_gaps(t, ["survey"], "ping", "a", "f", block=16).select("survey", "ping", F.round("f", 6).alias("v"))


def _reflect(t, half_lo, half_hi, agg, out, x):
    """Windowed aggregate with mirrored ends as SQL."""
    return f"""{out} AS (SELECT t.survey, t.ping, {agg} AS {out}_v FROM {t} t JOIN (SELECT survey, count(*) AS n FROM {t} GROUP BY survey) c USING (survey)
  JOIN (SELECT unnest(range(-{half_lo}, {half_hi} + 1)) AS d) o ON true JOIN {t} u ON u.survey = t.survey AND
  u.ping = CASE WHEN t.ping + d < 0 THEN -1 - (t.ping + d) WHEN t.ping + d >= n THEN 2 * n - 1 - (t.ping + d) ELSE t.ping + d END GROUP BY t.survey, t.ping)"""


@query("w3_reference_track", "v_nav", f"""
WITH t AS (SELECT survey, ping, coalesce(altitude, 8) + (ping % 13 = 5)::INT * 4 AS x FROM v_nav), {_reflect('t', 7, 7, 'median(u.x)', 'r', 'x')}
SELECT survey, ping, round(r_v, 6) AS ref, abs(x - r_v) > 1.5 AS outlier FROM r JOIN t USING (survey, ping)""")
def w3(s):
    n = s.v_nav.groupBy("survey").agg(F.count("*").alias("n"))
    t = s.v_nav.withColumn("x", F.coalesce("altitude", F.lit(8.0)) + F.when(F.col("ping") % 13 == 5, 4.0).otherwise(0.0)).join(n, "survey")
    r = framed(t, ["survey"], "ping", "n", 7, 7, {"ref": lambda w: F.percentile("x", F.lit(0.5)).over(w)}, block=16)
    return r.select("survey", "ping", F.round("ref", 6).alias("ref"), (F.abs(F.col("x") - F.col("ref")) > 1.5).alias("outlier"))


TRACK = f"""{SMOOTH}, fu AS (SELECT survey, ping, avg(CASE WHEN first >= 0 THEN (first + 0.5) * {RES} END) AS fused FROM fr GROUP BY ALL),
{_fill('fu', 'fused', 'g0')}, {_reflect('g0', 7, 7, 'median(u.filled)', 'rf', 'filled')},
jd AS (SELECT survey, ping, CASE WHEN abs(fused - rf_v) <= 1.5 THEN fused END AS kept FROM fu JOIN rf USING (survey, ping)),
{_fill('jd', 'kept', 'g1')}, {_reflect('g1', 3, 3, 'avg(u.filled)', 'al', 'filled')}"""


@query("w5_bottom_track", "v_samples", f"""
WITH {TRACK} SELECT survey, ping, round(al_v, 6) AS altitude_m, kept IS NOT NULL AS valid FROM al JOIN jd USING (survey, ping)""")
def w5(s):
    bottom, _ = C.track_bottom(traces(s), nav(s), C.survey_geometry(traces(s), s.v_nav))
    return bottom.select("survey", "ping", F.round("altitude_m", 6).alias("altitude_m"), "valid")


FIRST = f"{TRACK}, ff AS (SELECT survey, ping, al_v AS alt, CAST(greatest(least(round_even(al_v / {RES}, 0), 63), 0) AS INT) AS fr FROM al)"


@query("f8_blank_water", "v_samples", f"""
WITH {FIRST} SELECT survey, side, ping, round(sum(CASE WHEN col < fr THEN 0 ELSE v END), 6) AS total FROM v_samples JOIN ff USING (survey, ping) GROUP BY ALL""")
def f8(s):
    t = traces(s)
    _, first = C.track_bottom(t, nav(s), C.survey_geometry(t, s.v_nav))
    b = t.join(first, KEYS).withColumn("b", P.blank_water_column("samples", "first_return"))
    return b.select(*KEYS, F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a3_gain_bins", "v_samples", """
WITH p AS (SELECT survey, side, CAST(floor(col * 16 / 64) AS INT) AS bin, v FROM v_samples WHERE col >= 12 + 8)
SELECT survey, side, bin, round(quantile_cont(v, 0.5), 6) AS m, round(any_value(t), 6) AS target FROM p JOIN (SELECT survey, side, quantile_cont(v, 0.5) AS t
  FROM p GROUP BY ALL) USING (survey, side) GROUP BY survey, side, bin""")
def a3(s):
    t = traces(s)
    b = C.gain_bins(t, t.select(*KEYS, F.lit(12).alias("first_return")), 16)
    return b.select("survey", "side", "bin", F.round("bin_median", 6).alias("m"), F.round("target", 6).alias("target"))


GAIN = """p AS (SELECT survey, side, CAST(floor(col * 16 / 64) AS INT) AS bin, v FROM v_samples WHERE col >= 20),
b AS (SELECT survey, side, bin, bin * 4 + 1.5::DOUBLE AS c, quantile_cont(v, 0.5) AS m FROM p GROUP BY ALL),
t AS (SELECT survey, side, quantile_cont(v, 0.5) AS t FROM p GROUP BY ALL),
f AS (SELECT k.survey, k.side, kb AS bin, kb * 4 + 1.5::DOUBLE AS c, coalesce(b.m, (SELECT first(m ORDER BY bin) FROM b q WHERE q.survey = k.survey AND q.side = k.side)) AS m
  FROM (SELECT survey, side, unnest(range(0, 16)) AS kb FROM t) k LEFT JOIN b ON b.survey = k.survey AND b.side = k.side AND b.bin = kb),
g AS (SELECT l.survey, l.side, col, CASE WHEN lo.m IS NULL THEN hi.m WHEN hi.m IS NULL THEN lo.m ELSE lo.m + (hi.m - lo.m) * (col - lo.c) / 4 END / t.t AS gain
  FROM (SELECT survey, side, unnest(range(0, 64)) AS col FROM t) l JOIN t USING (survey, side)
  LEFT JOIN f lo ON lo.survey = l.survey AND lo.side = l.side AND lo.bin = floor((col - 1.5) / 4) LEFT JOIN f hi ON hi.survey = l.survey AND hi.side = l.side AND hi.bin = floor((col - 1.5) / 4) + 1)"""


def _gain(s):
    t = traces(s)
    return C.gain_curves(C.gain_bins(t, t.select(*KEYS, F.lit(12).alias("first_return")), 16), C.survey_geometry(t, s.v_nav), 16)


@query("a4_gain_curve", "v_samples", f"WITH {GAIN} SELECT survey, side, CAST(col AS INT) AS col, round(gain, 6) AS gain FROM g")
def a4(s):
    return _gain(s).select("survey", "side", F.posexplode("gain").alias("col", "g")).select("survey", "side", "col", F.round("g", 6).alias("gain"))


@query("x14_normalised", "v_samples", f"""
WITH {GAIN} SELECT survey, side, ping, round(sum(CASE WHEN col < 12 THEN v ELSE v / gain END), 5) AS total FROM v_samples JOIN g USING (survey, side, col) GROUP BY ALL""")
def x14(s):
    j = C.salted_join(traces(s), _gain(s), C.SIDE, "ping")
    n = j.withColumn("n", C.normalise_gain("samples", "gain", F.lit(12)))
    return n.select(*KEYS, F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("a40_ground_grid", "v_samples", f"""
WITH {FIRST} SELECT survey, side, round({RES}, 9) AS ground_res, CAST(floor(sqrt(2500 - pow(min(alt), 2)) / {RES}) AS INT) AS n_cols FROM ff
JOIN (SELECT DISTINCT survey, side FROM v_samples) USING (survey) GROUP BY survey, side""")
def a40(s):
    t = traces(s)
    geom = C.survey_geometry(t, s.v_nav)
    bottom, _ = C.track_bottom(t, nav(s), geom)
    return C.ground_grid(geom, bottom).select("survey", "side", F.round("ground_res", 9).alias("ground_res"), "n_cols")


@query("x12_ground_range", "v_samples", f"""
WITH {FIRST}, nc AS (SELECT survey, floor(sqrt(2500 - pow(min(alt), 2)) / {RES}) AS n FROM ff GROUP BY survey),
xt AS (SELECT ff.survey, sd.side, ping, fr, j, sqrt(pow((j + 0.5) * {RES}, 2) + pow(alt, 2)) / {RES} - 0.5 AS s FROM ff JOIN nc USING (survey)
  JOIN (SELECT DISTINCT survey, side FROM v_samples) sd USING (survey) JOIN (SELECT unnest(range(0, 64)) AS j) x ON j < n)
SELECT xt.survey, xt.side, xt.ping, CAST(j AS INT) AS col, round(CASE WHEN s <= 63 AND s >= fr THEN a.v + (coalesce(b.v, a.v) - a.v) * (s - floor(s)) END, 6) AS v FROM xt
LEFT JOIN v_samples a ON a.survey = xt.survey AND a.side = xt.side AND a.ping = xt.ping AND a.col = floor(s)
LEFT JOIN v_samples b ON b.survey = xt.survey AND b.side = xt.side AND b.ping = xt.ping AND b.col = floor(s) + 1""")
def x12(s):
    t = traces(s)
    geom = C.survey_geometry(t, s.v_nav)
    bottom, first = C.track_bottom(t, nav(s), geom)
    return long_rows(C.slant_to_ground(t, first, bottom, C.ground_grid(geom, bottom)))


NEIGH = """nb AS MATERIALIZED (SELECT t.survey, t.side, t.ping, t.col, t.v AS v0, u.v AS v FROM im t JOIN (SELECT survey, side, max(ping) + 1 AS n FROM im GROUP BY ALL) c USING (survey, side)
  JOIN (SELECT unnest(range(-{h}, {h} + 1)) AS dr) r ON true JOIN (SELECT unnest(range(-{h}, {h} + 1)) AS dc) q ON true
  JOIN im u ON u.survey = t.survey AND u.side = t.side
  AND u.ping = CASE WHEN t.ping + dr < 0 THEN -1 - (t.ping + dr) WHEN t.ping + dr >= n THEN 2 * n - 1 - (t.ping + dr) ELSE t.ping + dr END
  AND u.col = CASE WHEN t.col + dc < 0 THEN -1 - (t.col + dc) WHEN t.col + dc >= 64 THEN 127 - (t.col + dc) ELSE t.col + dc END)"""
STATS = f"{IMAGE}, {NEIGH.format(h=2)}, st AS (SELECT survey, side, ping, col, any_value(v0) AS v0, avg(v) AS mu, greatest(avg(v * v) - avg(v) * avg(v), 0) AS var FROM nb GROUP BY ALL)"


@query("w14_local_stats", "v_samples", f"WITH {STATS.replace('any_value(v0)', 'max(v0)')} SELECT survey, side, ping, CAST(col AS INT) AS col, round(mu, 5) AS mu, round(var, 3) AS var FROM st")
def w14(s):
    st = C.local_stats(image(s), shape(s), 5, block=16)
    z = st.select(*KEYS, F.posexplode(F.arrays_zip("mu", "var")).alias("col", "z"))
    return z.select(*KEYS, "col", F.round("z.mu", 5).alias("mu"), F.round("z.var", 3).alias("var"))


LEE = STATS.replace("any_value(v0)", "max(v0)") + """, cu AS (SELECT survey, side, quantile_cont(sqrt(var) / mu, 0.5) AS cu FROM st GROUP BY ALL),
lf AS (SELECT survey, side, ping, col, v0, mu, cu, greatest(var - cu * cu * mu * mu, 0) / (1 + cu * cu) AS sg FROM st JOIN cu USING (survey, side))"""


@query("a5_speckle_level", "v_samples", f"WITH {LEE} SELECT survey, side, round(cu, 7) AS cu FROM cu")
def a5(s):
    return C.speckle_level(C.local_stats(image(s), shape(s), 5, block=16)).select("survey", "side", F.round("cu", 7).alias("cu"))


@query("p3_despeckle_lee", "v_samples", f"""
WITH {LEE} SELECT survey, side, ping, CAST(col AS INT) AS col, round(CASE WHEN v0 IS NOT NULL THEN mu + coalesce(sg / nullif(sg + cu * cu * (mu * mu + sg), 0), 0) * (v0 - mu) END, 4) AS v FROM lf""")
def p3(s):
    return long_rows(C.despeckle(image(s), shape(s), "lee", block=16), digits=4)


def _median_of(table, value, h, names):
    """Median over (2h + 1) x (2h + 1) places, mirrored at the edges, of a table of pixels."""
    turned = lambda p, n: f"CASE WHEN {p} < 0 THEN -1 - ({p}) WHEN {p} >= {n} THEN 2 * {n} - 1 - ({p}) ELSE {p} END"
    return f"""(SELECT a.survey, a.side, a.ping, a.col, quantile_cont(b.{value}, 0.5) AS {names} FROM (SELECT survey, side, ping, col, n, {turned('ping + dp', 'n')} AS bp, {turned('col + dc', 64)} AS bc
  FROM {table} JOIN sz USING (survey, side), (SELECT unnest(range({-h}, {h + 1})) AS dp) x, (SELECT unnest(range({-h}, {h + 1})) AS dc) y) a
  JOIN {table} b ON b.survey = a.survey AND b.side = a.side AND b.ping = a.bp AND b.col = a.bc GROUP BY a.survey, a.side, a.ping, a.col)"""


@query("w15_impulse_median", "v_samples", f"""
WITH {IMAGE}, sz AS (SELECT survey, side, max(ping) + 1 AS n FROM im GROUP BY ALL), fl AS (SELECT survey, side, quantile_cont(v, 0.5) AS fill FROM im GROUP BY ALL),
f AS MATERIALIZED (SELECT survey, side, ping, col, coalesce(v, fill) AS v, v IS NOT NULL AS ok FROM im JOIN fl USING (survey, side)),
m AS MATERIALIZED (SELECT f.*, med, abs(v - med) AS dev FROM f JOIN {_median_of('f', 'v', 1, 'med')} q USING (survey, side, ping, col)),
r AS (SELECT m.*, mad FROM m JOIN {_median_of('m', 'dev', 3, 'mad')} q USING (survey, side, ping, col))
SELECT survey, side, ping, CAST(col AS INT) AS col, CASE WHEN ok THEN round(CASE WHEN dev > 3.0::DOUBLE * 1.4826::DOUBLE * mad THEN med ELSE v END, 6) END AS v FROM r""")
def w15(s):
    return long_rows(C.despeckle(image(s), shape(s), "median", block=16))


MASK = f"{IMAGE}, mk AS (SELECT survey, side, ping, col, coalesce(v > 110, false)::INT AS m FROM im)"


def mask(s):
    return image(s).select(*KEYS, F.transform("cols", lambda v: v > 110.0).alias("mask"))


@query("w16_opening", "v_samples", f"""
WITH {MASK}, er AS (SELECT t.survey, t.side, t.ping, t.col, (sum(u.m) = 9)::INT AS e FROM mk t JOIN mk u ON u.survey = t.survey AND u.side = t.side
  AND u.ping BETWEEN t.ping - 1 AND t.ping + 1 AND u.col BETWEEN t.col - 1 AND t.col + 1 GROUP BY ALL)
SELECT t.survey, t.side, t.ping, CAST(t.col AS INT) AS col FROM er t JOIN er u ON u.survey = t.survey AND u.side = t.side AND u.ping BETWEEN t.ping - 1 AND t.ping + 1
AND u.col BETWEEN t.col - 1 AND t.col + 1 GROUP BY ALL HAVING max(u.e) = 1""")
def w16(s):
    o = C.open_mask(mask(s), shape(s), block=16)
    return o.select(*KEYS, F.posexplode("mask").alias("col", "m")).where("m").drop("m")


@query("a6_stretch_u8", "v_samples", f"""
WITH {IMAGE}, l AS (SELECT survey, side, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM im GROUP BY ALL)
SELECT survey, side, ping, CAST(col AS INT) AS col, coalesce(CAST(floor(greatest(least((v - lo) / (hi - lo), 1), 0) * 255 + 0.5) AS INT), 0) AS v FROM im JOIN l USING (survey, side)""")
def a6(s):
    return C.stretch_u8(image(s)).select(*KEYS, F.posexplode("cols").alias("col", "v"))


@query("a7_equalised", "v_samples", f"""
WITH {IMAGE}, lim AS (SELECT survey, side, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.997) AS hi, max(ping) + 1 AS n FROM im GROUP BY ALL),
cd AS MATERIALIZED (SELECT survey, side, ping, col, v, n, least(8, n) AS gy, CAST(ceil(n / least(8, n)) AS BIGINT) AS th,
  CAST(round_even(greatest(least((coalesce(v, lo) - lo) / (hi - lo), 1), 0) * 65535.0::DOUBLE, 0) AS BIGINT) AS code FROM im JOIN lim USING (survey, side)),
rr AS (SELECT *, ping AS r FROM cd UNION ALL SELECT *, 2 * (n - 1) - ping FROM cd WHERE 2 * (n - 1) - ping >= n AND 2 * (n - 1) - ping < th * gy),
hc AS (SELECT survey, side, CAST(r // th AS BIGINT) AS cy, CAST(col // 8 AS BIGINT) AS cx, th, code AS k, count(*) AS m FROM rr GROUP BY ALL),
h AS MATERIALIZED (SELECT survey, side, cy, cx, th * 8 AS area, k, least(m, greatest(floor(2.5 * th * 8 / 65536), 1)) AS c FROM hc),
cell AS (SELECT survey, side, cy, cx, area, CAST(max(area) - sum(c) AS BIGINT) AS excess FROM h GROUP BY ALL),
cum AS (SELECT survey, side, cy, cx, k, sum(c) OVER (PARTITION BY survey, side, cy, cx ORDER BY k) AS base FROM h),
pl AS (SELECT *, ping / th::DOUBLE - 0.5 AS ty, col / 8::DOUBLE - 0.5 AS tx FROM cd),
co AS (SELECT survey, side, ping, col, code, dy, dx, CAST(CASE dy WHEN 0 THEN greatest(floor(ty), 0) ELSE least(floor(ty) + 1, gy - 1) END AS BIGINT) AS cy, CAST(CASE dx WHEN 0 THEN greatest(floor(tx), 0) ELSE least(floor(tx) + 1, 7) END AS BIGINT) AS cx,
  CASE dy WHEN 0 THEN 1 - (ty - floor(ty)) ELSE ty - floor(ty) END * CASE dx WHEN 0 THEN 1 - (tx - floor(tx)) ELSE tx - floor(tx) END AS w
  FROM pl, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b),
lu AS (SELECT co.*, area, excess, coalesce(base, 0) + excess // 65536 * (co.code + 1)
    + CASE WHEN excess % 65536 > 0 THEN least(co.code // greatest(65536 // (excess % 65536), 1) + 1, excess % 65536) ELSE 0 END AS total
  FROM co JOIN cell USING (survey, side, cy, cx) ASOF LEFT JOIN cum ON cum.survey = co.survey AND cum.side = co.side AND cum.cy = co.cy AND cum.cx = co.cx AND co.code >= cum.k),
pt AS (SELECT survey, side, ping, col, dy, dx, w * greatest(least(round_even(total * (65535.0::DOUBLE / area), 0), 65535), 0) AS p FROM lu),
su AS (SELECT survey, side, ping, col, max(p) FILTER (dy = 0 AND dx = 0) + max(p) FILTER (dy = 0 AND dx = 1) + max(p) FILTER (dy = 1 AND dx = 0) + max(p) FILTER (dy = 1 AND dx = 1) AS res FROM pt GROUP BY ALL)
SELECT survey, side, ping, CAST(col AS INT) AS col, CASE WHEN v IS NOT NULL THEN round(round_even(res, 0) / 65535, 6) END AS v FROM cd JOIN su USING (survey, side, ping, col)""")
def a7(s):
    return long_rows(C.equalise(image(s), shape(s), block=16))


@query("a7_equalised_range", "v_samples", f"WITH {IMAGE} SELECT survey, side, count(*) AS pixels, count(v) AS finite, true AS within FROM im GROUP BY ALL")
def a7_range(s):
    """Same no-data pixels, every value inside 0..1."""
    e = C.equalise(image(s), shape(s), block=16).select(*C.SIDE, F.explode("cols").alias("v"))
    return e.groupBy(*C.SIDE).agg(F.count("*").alias("pixels"), F.count("v").alias("finite"),
                                  ((F.min("v") >= 0) & (F.max("v") <= 1)).alias("within"))


TILES = f"""{IMAGE}, sh AS (SELECT survey, side, max(ping) + 1 AS n FROM im GROUP BY ALL),
ro AS (SELECT survey, side, n, unnest(list_distinct(list_concat(range(0, greatest(n - 20, 0) + 1, 15), [greatest(n - 20, 0)]))) AS row0 FROM sh),
t AS (SELECT *, unnest(list_distinct(list_concat(range(0, 45, 15), [44]))) AS col0 FROM ro),
c AS (SELECT t.survey, t.side, CAST(row0 AS INT) AS row0, CAST(col0 AS INT) AS col0, count(v) AS n_finite FROM t JOIN im ON im.survey = t.survey AND im.side = t.side AND ping >= row0 AND ping < row0 + 20
  AND col >= col0 AND col < col0 + 20 GROUP BY ALL)"""


@query("w19_tiles", "v_samples", f"""
WITH {TILES} SELECT *, CAST(row_number() OVER (PARTITION BY survey ORDER BY side, row0, col0) - 1 AS INT) AS tile_index FROM c WHERE n_finite >= 0.9 * 400""")
def w19(s):
    return C.tiles_of(image(s), shape(s), 20, 0.25, 0.9).select("survey", "side", "row0", "col0", "n_finite", "tile_index")


def _tiles20(s):
    return C.tiles_of(image(s), shape(s), 20, 0.25, 0.0)


@query("a12_tile_content", "v_samples", f"WITH {TILES} SELECT * FROM c")
def a12(s):
    return C.count_finite(image(s), C.tile_origins(shape(s), 20, 0.25), 16).select("survey", "side", "row0", "col0", "n_finite")


@query("f12_content_filter", "v_samples", f"WITH {TILES} SELECT survey, side, count(*) AS tiles FROM c WHERE n_finite > 0 AND n_finite >= 0.91 * 400 GROUP BY ALL")
def f12(s):
    return C.tiles_of(image(s), shape(s), 20, 0.25, 0.91).groupBy("survey", "side").agg(F.count("*").alias("tiles"))


@query("j4_tile_pixels", "v_samples", f"""
WITH {TILES} SELECT c.survey, c.side, row0, col0, CAST(ping - row0 AS INT) AS r, round(sum(v), 5) AS total FROM c JOIN im ON im.survey = c.survey AND im.side = c.side
AND ping >= row0 AND ping < row0 + 20 AND col >= col0 AND col < col0 + 20 GROUP BY ALL""")
def j4(s):
    t = _tiles20(s)
    rows = C.tile_rows(image(s), t, 16).join(t.select("survey", "tile_index", "row0", "col0"), ["survey", "tile_index"])
    return rows.select("survey", "side", "row0", "col0", "r", F.round(F.aggregate("cols", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 5).alias("total"))


def _over_195():
    """A toy detector: the bounding box of the pixels above 195 of each tile."""
    import numpy as np

    def find(tensor):
        out = {"tile": [], "x1": [], "y1": [], "x2": [], "y2": [], "cls": [], "score": []}
        for i, image in enumerate(tensor):
            r, c = np.nonzero(np.nan_to_num(image, nan=0.0) > 195)
            if len(r):
                for k, v in zip(out, (i, c.min(), r.min(), c.max() + 1, r.max() + 1, "bright" if len(r) > 3 else "speck", len(r) / image.size)):
                    out[k].append(v)
        return out

    return find


@query("p2_injected_detector", "v_samples", f"""
WITH {TILES} SELECT c.survey, c.side, row0, col0, CAST(min(ping) AS INT) AS ping0, CAST(max(ping) AS INT) AS ping1, CAST(min(col) AS INT) AS c0, CAST(max(col) AS INT) AS c1,
  CASE WHEN count(*) > 3 THEN 'bright' ELSE 'speck' END AS cls, count(*) / 400::DOUBLE AS score
FROM c JOIN im ON im.survey = c.survey AND im.side = c.side AND ping >= row0 AND ping < row0 + 20 AND col >= col0 AND col < col0 + 20
WHERE CAST(v AS FLOAT) > 195 AND n_finite > 0 GROUP BY c.survey, c.side, row0, col0""")
def p2(s):
    from pingframe.operators import injected as J
    t = _tiles20(s)
    d = J.detect(image(s), shape(s), _over_195, 20, 0.25)
    at = t.select("survey", "side", "tile_index", "row0", F.col("col0").alias("tcol0"))
    return d.join(at, ["survey", "side", "tile_index"]).select("survey", "side", "row0", F.col("tcol0").alias("col0"), "ping0", "ping1", F.col("col0").alias("c0"), F.col("col1").alias("c1"), "cls", "score")


@query("u2_tile_ids", "v_samples", "SELECT survey, count(DISTINCT side) AS sides, true AS dense FROM v_samples GROUP BY survey")
def u2(s):
    t = _tiles20(s)
    return t.groupBy("survey").agg(F.count_distinct("side").alias("sides"),
                                   ((F.count_distinct("tile_index") == F.count("*")) & (F.max("tile_index") + 1 == F.count("*"))).alias("dense"))


@query("p5_conditioning_chain")
def p5(s):
    c = condition(traces(s), nav(s), n_bins=64, tile=32)
    return c.tiles.select("survey", "side", "tile_index", "row0", "col0", "n_finite")


@query("st6_grid_scaling", "v_contacts", "SELECT id, CAST(greatest(1, round_even(8 * (seq % 300 + 10)::DOUBLE / 600, 0)) AS INT) AS rows FROM v_contacts")
def st6(s):
    return s.v_contacts.select("id", C.scaled_rows(8, F.col("seq") % 300 + 10, F.lit(600)).alias("rows"))


@query("x38_mosaic_res", "v_contacts", "SELECT id, coalesce(nullif(height_m, 0), nullif(CASE WHEN length_m > 3 THEN 0 ELSE length_m END, 0), 1.0) AS res FROM v_contacts")
def x38(s):
    return s.v_contacts.select("id", P.mosaic_ground_res("height_m", F.when(F.col("length_m") > 3, 0.0).otherwise(F.col("length_m"))).alias("res"))
