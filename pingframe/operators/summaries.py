"""Survey and contact summaries: coverage, counts, bands, review progress, briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import half_even
from ..functions.geodesy import short_distance_m
from ..functions.geometry import across_track_res, along_track_res, sound_speed_range_error
from ..functions.scoring import severity_band
from ..functions.text import top_contact_line
from .filters import top_per_group
from .scale import exact_percentiles, neighbours_in_order


def track_legs(nav: DataFrame) -> DataFrame:
    """Distance from the previous finite fix of the survey, per ping (first fix: NULL)."""
    fixes = nav.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "survey", "ping", F.struct("lat", "lon", "ping").alias("fix"))
    before = neighbours_in_order(
        # the previous fix of ping p is the fix at or before p-1
        fixes.withColumn("_at", F.col("ping") + 1).select("survey", F.col("_at").alias("ping"), "fix")
        .unionByName(fixes.select("survey", "ping", F.lit(None).cast("struct<lat:double,lon:double,ping:int>").alias("fix")))
        .groupBy("survey", "ping").agg(F.max("fix").alias("fix")), ["survey"], "ping", "fix")
    joined = fixes.join(before.select("survey", "ping", F.col("_pv").alias("prev")), ["survey", "ping"], "left")
    leg = short_distance_m("prev.lat", "prev.lon", "fix.lat", "fix.lon")
    return joined.select("survey", "ping", F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon"),
                         leg.alias("leg_m"))


def survey_coverage(nav: DataFrame, ground: DataFrame, geom: DataFrame, altitude: DataFrame | None = None) -> DataFrame:
    """Track length, swath, area, medians and resolution limits per survey.

    `ground(survey, side, ping, n_finite)`, `geom(survey, side, ground_res)`; NULL-aware throughout.
    """
    track = track_legs(nav).groupBy("survey").agg(
        F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("track_m"), F.count(F.lit(1)).alias("n_fixes"))
    swath = (ground.groupBy("survey", "side").agg(F.avg(F.col("n_finite").cast("double")).alias("w"))
             .join(geom.select("survey", "side", "ground_res"), ["survey", "side"])
             .groupBy("survey").agg(F.sum(F.col("w") * F.col("ground_res")).alias("swath_m")))
    ranges = exact_percentiles(nav.where(F.col("slant_range") > 0), ["survey"], "slant_range", {"range_med": 0.5})
    speed = exact_percentiles(nav.where(F.col("sound_velocity") > 0), ["survey"], "sound_velocity", {"sv_med": 0.5})
    base = nav.groupBy("survey").agg(
        F.count(F.lit(1)).alias("n_pings"),
        F.max(F.when(F.col("slant_range") > 0, F.col("slant_range"))).alias("max_range"))
    alt = (altitude if altitude is not None else nav.select("survey", F.col("altitude").alias("altitude_m")))
    alt = alt.groupBy("survey").agg(F.avg("altitude_m").alias("alt_mean"))
    out = base
    for part in (track, swath, ranges, speed, alt):
        out = out.join(part, "survey", "left")
    sv, far = F.coalesce("sv_med", F.lit(K.SONAR["sv_mps"])), F.coalesce("max_range", F.lit(0.0))
    track_m, swath_m = F.coalesce("track_m", F.lit(0.0)), F.coalesce("swath_m", F.lit(0.0))
    return out.select(
        "survey",
        F.when(F.col("n_fixes") > 0, F.lit("recorded")).otherwise(F.lit("none")).alias("nav_source"),
        half_even(track_m / 1000.0, 3).alias("track_length_km"),
        half_even(swath_m, 1).alias("swath_width_m"),
        half_even(track_m * swath_m / 1e6, 4).alias("area_surveyed_sqkm"),
        half_even("range_med", 1).alias("range_m"), half_even("alt_mean", 1).alias("altitude_m"),
        "n_pings", half_even(sv, 1).alias("sound_velocity_mps"),
        half_even(across_track_res(sv), 4).alias("across_track_resolution_m"),
        half_even(along_track_res(far), 3).alias("along_track_resolution_max_m"),
        half_even(sound_speed_range_error(far), 3).alias("sound_speed_range_error_max_m"))


def summary_block(contacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Totals, confident contacts and density per survey; density is NULL when the area is 0."""
    per = contacts.groupBy("survey").agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.count_if(F.col("confidence") >= K.HIGH_CONFIDENCE_PCT).alias("high_confidence"))
    area = F.when(F.col("area_surveyed_sqkm") != 0, F.col("area_surveyed_sqkm"))
    return (per.join(coverage.select("survey", "area_surveyed_sqkm"), "survey", "left")
            .withColumn("debris_density_per_sqkm", half_even(F.try_divide(F.col("total_detections").cast("double"), area), 2)))


def count_by_class(contacts: DataFrame, *keys: str) -> DataFrame:
    return contacts.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, F.desc("n"), "cls")


def band_histogram(contacts: DataFrame) -> DataFrame:
    """Contacts per survey and severity band, empty bands included."""
    counts = contacts.groupBy("survey", severity_band("severity").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = F.array(*[F.lit(b[1]) for b in K.SEVERITY_BANDS])
    frame = counts.select("survey").distinct().withColumn("band", F.explode(bands))
    return frame.join(counts, ["survey", "band"], "left").na.fill(0, ["n"])


def physics_tally(contacts: DataFrame, *keys: str) -> DataFrame:
    return contacts.groupBy(*keys).agg(
        F.count_if(F.col("highlight") & F.col("shadow")).alias("both_cues"),
        F.count_if(F.col("height_m").isNotNull()).alias("with_height"),
        F.count_if("violation").alias("violations"), F.avg("confidence").alias("mean_confidence"))


def review_progress(contacts: DataFrame) -> DataFrame:
    """Review counts, share reviewed and the closest layer approach per survey.

    Needs `nearest_layer` and `nearest_layer_distance_m`; ties go to the lowest id.
    """
    near = F.when(F.col("nearest_layer").isNotNull() & F.col("nearest_layer_distance_m").isNotNull(),
                  F.struct(F.col("nearest_layer_distance_m").alias("d"), F.col("id"), F.col("nearest_layer").alias("layer")))
    return contacts.groupBy("survey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("review") == "confirmed").alias("confirmed"),
        F.count_if(F.col("review") == "rejected").alias("rejected"),
        F.count_if(F.col("review") == "pending").alias("pending"),
        F.min(near).alias("near"),
    ).select("survey", "n", "confirmed", "rejected", "pending",
             half_even(100.0 * (F.col("confirmed") + F.col("rejected")) / F.col("n"), 0).alias("reviewed_pct"),
             F.col("near.layer").alias("closest_layer"), F.col("near.d").alias("closest_m"),
             F.col("near.id").alias("closest_id"))


def work_queue(contacts: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(contacts, ["survey"], [F.desc("severity"), F.asc("id")], k)


def briefing(contacts: DataFrame) -> DataFrame:
    """One markdown briefing per survey, all surveys in one job."""
    classes = (count_by_class(contacts, "survey").groupBy("survey")
               .agg(F.count(F.lit(1)).alias("n_classes"), F.array_sort(F.collect_list(F.struct(
                   (-F.col("n")).alias("o"), "cls", "n"))).alias("cl")))     # at most the class list
    class_bits = F.array_join(F.transform("cl", lambda c: F.format_string("%s x%d", c["cls"], c["n"])), ", ")
    top = (work_queue(contacts, 3).groupBy("survey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), top_contact_line("rank", "id", "cls", "severity", "lat", "lon").alias("line")))).alias("top")))
    tally = physics_tally(contacts, "survey").select("survey", "violations")
    d = review_progress(contacts).join(classes, "survey").join(top, "survey").join(tally, "survey")
    layer_line = F.when(F.col("closest_layer").isNotNull(), F.format_string(
        "**Sensitive layers:** closest approach is %s, %s m from %s.",
        F.replace("closest_layer", F.lit("_"), F.lit(" ")), F.col("closest_m").cast("string"), F.col("closest_id"))
    ).otherwise(F.lit("**Sensitive layers:** no contact near a sensitive layer."))
    lines = F.concat_ws(
        "\n",
        F.format_string("## Survey summary — survey %s", F.col("survey")), F.lit(""),
        F.format_string("**%d contact(s)** across %d class(es): %s.", F.col("n"), F.col("n_classes"), class_bits),
        F.lit(""), F.lit("**Top contacts by severity:**"),
        F.array_join(F.transform("top", lambda t: t["line"]), "\n"), F.lit(""),
        F.format_string("**Physics violations:** %d of %d contact(s) flagged.", F.col("violations"), F.col("n")),
        F.format_string("**Review progress:** %d confirmed, %d rejected, %d pending (%.0f%% reviewed).",
                        F.col("confirmed"), F.col("rejected"), F.col("pending"), F.col("reviewed_pct")),
        layer_line)
    return d.select("survey", lines.alias("briefing"))


def distinct_classes(contacts: DataFrame) -> DataFrame:
    return contacts.select("cls").distinct().orderBy("cls")


def class_answer(spark: SparkSession, contacts: DataFrame, n: int = 5, by: str = "severity", **where) -> DataFrame:
    """Answer rows of a top-N question with the text line shown to the operator."""
    from ..functions.text import answer_line
    from .filters import contact_filter, top_contacts
    return top_contacts(contacts, n, by, contact_filter(**where)).select(
        "id", "cls", "confidence", "severity", "lat", "lon", "review",
        answer_line("id", "cls", "severity", "confidence").alias("line"))
