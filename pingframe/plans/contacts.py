"""Verified detections -> geotagged, ranked contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions import scoring as S
from ..functions.columns import half_even
from ..functions.geometry import along_track_res
from ..functions.text import brain_letters
from ..operators.filters import is_reportable
from ..operators.joins import range_join
from ..operators.layers import nearest_layer
from ..operators.scale import ranked, salted_join


def survey_dates(nav: DataFrame) -> DataFrame:
    """Date part of contact ids: day of the first ping with a time."""
    first = F.min_by("time", "ping").alias("t")
    d = nav.where("time IS NOT NULL").groupBy("survey").agg(first)
    return d.select("survey", F.date_format(F.timestamp_seconds("t"), "yyyyMMdd").alias("date_part"))


def contact_ids(verified: DataFrame, nav: DataFrame, prefix: str = "SN") -> DataFrame:
    """Reportable detections numbered per survey in confidence order: prefix-date-0001."""
    kept = verified.where(is_reportable("cls"))
    rows = ranked(kept, ["survey"], [F.desc("confidence_pct"), F.asc("det_id")], "_seq")
    dated = salted_join(rows, survey_dates(nav), ["survey"], "det_id", how="left")
    cid = F.format_string(f"{prefix}-%s-%04d", F.coalesce("date_part", F.lit("unknown-date")), F.col("_seq"))
    return dated.withColumn("id", cid).drop("_seq", "date_part")


def _fixes(dets: DataFrame, nav: DataFrame) -> DataFrame:
    """Nav fix at the first, centre and last ping of each box, plus speed and time over it."""
    cols = ["lat", "lon", "heading", "layback", "sensor_depth", "time", "speed"]
    d = dets.select("det_id", "survey", "ping0", "ping1", F.floor((F.col("ping0") + F.col("ping1")) / 2).cast("int").alias("pc"))
    j = range_join(nav.select("survey", F.col("ping").alias("row"), *cols), d, ["survey"], "row", "ping0", "ping1", 64)
    fix = F.struct("lat", "lon", "heading", "layback", "sensor_depth", "time")
    at = lambda p: F.max(F.when(F.col("row") == F.col(p), fix))
    return j.groupBy("det_id").agg(at("pc").alias("fix"), at("ping0").alias("fix0"), at("ping1").alias("fix1"), F.avg("speed").alias("speed"),
                                   F.count(F.lit(1)).alias("rows"), F.count("time").alias("timed"))


def geo_boxes(dets: DataFrame, nav: DataFrame, grid: DataFrame) -> DataFrame:
    """Centre, four corners, along/across metres per box."""
    d = salted_join(dets.join(_fixes(dets, nav), "det_id"), grid.select("survey", "side", "ground_res"), ["survey", "side"], "det_id")
    res = F.col("ground_res")
    g = lambda c: (c + 0.5) * res
    pos = lambda fix, c: G.pixel_position(fix, "side", g(c))
    d = d.withColumns({"centre": pos("fix", (F.col("col0") + F.col("col1")) / 2.0), "corners": F.array(
        pos("fix0", F.col("col0")), pos("fix0", F.col("col1")), pos("fix1", F.col("col1")), pos("fix1", F.col("col0")))})
    span = F.col("fix1.time") - F.col("fix0.time")
    timed = (F.col("rows") > 1) & (F.col("timed") == F.col("rows")) & (span > 0)
    along = F.when(timed, F.coalesce(F.col("speed") * span, F.lit(0.0))).otherwise(0.0)
    a, b = F.col("corners")[0], F.col("corners")[3]
    gap = G.short_distance_m(a["lat"], a["lon"], b["lat"], b["lon"])
    return d.withColumns({"along_m": F.when(along > 0, along).otherwise(gap), "across_m": F.abs(F.col("col1") - F.col("col0")) * res})


def build_contacts(verified: DataFrame, nav: DataFrame, bottom: DataFrame, grid: DataFrame, segments: DataFrame | None = None,
                   prefix: str = "SN", hazards: Column | None = None) -> DataFrame:
    """Nested contact rows from verified detections; positions to 1e-7 degree, sizes to centimetres."""
    d = geo_boxes(contact_ids(verified, nav, prefix), nav, grid)
    alt = lambda p, n: bottom.select("survey", F.col("ping").alias(p), F.col("altitude_m").alias(n))
    d = d.withColumn("pc", F.floor((F.col("ping0") + F.col("ping1")) / 2).cast("int"))
    d = d.join(alt("pc", "_alt_c"), ["survey", "pc"], "left").join(alt("ping0", "_alt_0"), ["survey", "ping0"], "left")
    d = d.withColumns({"lat": F.col("centre.lat"), "lon": F.col("centre.lon"), "height": F.col("analysis.height_m"),
                       "depth": F.col("fix.sensor_depth") + F.col("_alt_c"),
                       "ground_m": (0.5 * (F.col("col0") + F.col("col1")) + 0.5) * F.col("ground_res")})
    if segments is not None:
        d = nearest_layer(d, segments)
    else:
        null = F.lit(None)
        d = d.withColumns({"proximity": F.lit(0.0), "nearest_layer": null.cast("string"), "nearest_layer_kind": null.cast("string"),
                           "nearest_layer_distance_m": null.cast("double")})
    d = d.withColumn("terms", S.severity_terms("cls", F.col("along_m") * F.col("across_m"), "height", "depth", "proximity", hazards))
    d = d.withColumn("severity", S.severity_total("terms"))
    d = d.withColumn("act", S.recommend("cls", "severity", "depth", "nearest_layer_kind", "nearest_layer_distance_m"))
    slant = F.sqrt(F.col("ground_m") * F.col("ground_m") + F.col("_alt_0") * F.col("_alt_0"))
    a = lambda n, k=3: half_even(f"analysis.{n}", k).alias(n)
    iso = F.date_format(F.timestamp_seconds("fix.time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    t = S.severity_breakdown("terms")
    return d.select(
        "id", "cls", F.col("confidence_pct").alias("confidence"), brain_letters("brain").alias("brains"),
        half_even("lat", 7).alias("lat"), half_even("lon", 7).alias("lon"),
        F.transform("corners", lambda p: F.struct(F.bround(p["lat"], 7).alias("lat"), F.bround(p["lon"], 7).alias("lon"))).alias("corners"),
        F.struct(half_even("along_m", 2).alias("length_m"), half_even("across_m", 2).alias("width_m"), half_even("height", 2).alias("height_m"),
                 half_even(along_track_res(slant), 3).alias("along_track_resolution_m")).alias("dims"),
        F.struct(F.col("analysis.has_highlight").alias("highlight"), F.col("analysis.has_shadow").alias("shadow"), a("highlight_ratio"), a("shadow_ratio"),
                 a("shadow_len_m"), a("height_m", 2), F.col("gate.violation").alias("physics_violation"), F.col("gate.reason").alias("violation_reason"),
                 "multipath_suspect").alias("physics"),
        "severity", F.struct(*[t[n].alias(n) for n in ("hazard", "size", "height", "depth", "proximity")], "nearest_layer", "nearest_layer_kind",
                             "nearest_layer_distance_m").alias("severity_breakdown"),
        F.struct("side", "ping0", "ping1", "col0", "col1").alias("pixel"), half_even("depth", 1).alias("depth_m"), iso.alias("detected_at"), "survey",
        F.lit("pending").alias("review"), F.lit("flagged").alias("recovery"), F.lit(None).cast("string").alias("notes"),
        S.priority("severity").alias("priority"), F.col("act.action").alias("recommended_action"), F.col("act.rule").alias("action_rule"),
        F.col("act.requires").alias("action_requires"),
        half_even(S.position_accuracy("ground_res", F.col("fix.layback").isNotNull(), "ground_m", sv_frac=K.SONAR["sv_uncertainty"]), 2).alias("position_accuracy_m"))
