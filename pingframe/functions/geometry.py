"""Sonar geometry as column expressions: ranges, resolutions, shadows, columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SONAR
from .columns import ColumnLike, clamp, col, dbl, half_even


def slant_range_from_time(t_s: ColumnLike, sv_mps=SONAR["sv_mps"]) -> Column:
    return dbl(t_s) * dbl(sv_mps) * 0.5


def slant_range_from_samples(n: ColumnLike, interval_ns: ColumnLike, sv_mps: ColumnLike) -> Column:
    return dbl(n) * (dbl(interval_ns) / F.lit(1e9)) * dbl(sv_mps) * 0.5


def across_track_res(sv_mps=SONAR["sv_mps"], pulse_s=SONAR["pulse_s"]) -> Column:
    return dbl(sv_mps) * dbl(pulse_s) * 0.5


def along_track_res(range_m: ColumnLike, beam_deg=SONAR["beam_deg"]) -> Column:
    return F.radians(dbl(beam_deg)) * F.greatest(dbl(range_m), F.lit(0.0))


def resolution_cell(range_m: ColumnLike, beam_deg=SONAR["beam_deg"], sv_mps=SONAR["sv_mps"],
                    pulse_s=SONAR["pulse_s"]) -> Column:
    return F.struct(along_track_res(range_m, beam_deg).alias("along_m"),
                    across_track_res(sv_mps, pulse_s).alias("across_m"))


def sound_speed_range_error(range_m: ColumnLike, frac=SONAR["sv_uncertainty"]) -> Column:
    return F.abs(dbl(range_m)) * F.abs(dbl(frac))


def multipath_ground_range(altitude_m: ColumnLike, order: int = 2) -> Column:
    a = dbl(altitude_m)
    if order < 2:
        return F.lit(0.0)
    return F.when(a > 0, a * math.sqrt(order * order - 1.0)).otherwise(0.0)


def is_multipath_candidate(ground_m: ColumnLike, altitude_m: ColumnLike,
                           tolerance=SONAR["multipath_tolerance"], order: int = 2) -> Column:
    """Unknown geometry never flags."""
    expected = multipath_ground_range(altitude_m, order)
    hit = (expected > 0) & (F.abs(dbl(ground_m) - expected) <= abs(tolerance) * expected)
    return F.coalesce(hit, F.lit(False))


def resolution_curve(altitude_m: ColumnLike, range_m: ColumnLike, steps: int = 24, beam_deg=SONAR["beam_deg"],
                     sv_mps=SONAR["sv_mps"], pulse_s=SONAR["pulse_s"]) -> Column:
    """Array of resolution samples over the reachable swath (explode for rows)."""
    a = F.greatest(dbl(altitude_m), F.lit(0.0))
    s = F.greatest(dbl(range_m), F.lit(0.0))
    max_ground = F.sqrt(F.greatest(s * s - a * a, F.lit(0.0)))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: _curve_point(i, max_ground, a, steps, beam_deg, sv_mps, pulse_s))


def _curve_point(i: Column, max_ground: Column, a: Column, steps: int, beam_deg, sv_mps, pulse_s) -> Column:
    ground = max_ground * i / steps
    slant = F.sqrt(ground * ground + a * a)
    return F.struct(
        i.cast("int").alias("step"),
        half_even(ground, 2).alias("ground_range_m"),
        half_even(slant, 2).alias("slant_range_m"),
        half_even(along_track_res(slant, beam_deg), 4).alias("along_track_m"),
        half_even(across_track_res(sv_mps, pulse_s), 4).alias("across_track_m"),
    )


def resolution_rows(df: DataFrame, altitude_m: ColumnLike, range_m: ColumnLike, steps: int = 24, beam_deg=SONAR["beam_deg"],
                    sv_mps=SONAR["sv_mps"], pulse_s=SONAR["pulse_s"]) -> DataFrame:
    """`resolution_curve` as rows: the columns of `df` and those of a sample.  Steps are exploded first, so compiled code works out each sample."""
    a, s = F.greatest(dbl(altitude_m), F.lit(0.0)), F.greatest(dbl(range_m), F.lit(0.0))
    rows = df.select(*df.columns, a.alias("_a"), F.sqrt(F.greatest(s * s - a * a, F.lit(0.0))).alias("_max")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    point = _curve_point(F.col("_i"), F.col("_max"), F.col("_a"), steps, beam_deg, sv_mps, pulse_s).alias("_p")
    return rows.select(*df.columns, point).select(*df.columns, "_p.*")


def shadow_round_trip(altitude_m: ColumnLike, height_m: ColumnLike, ground_m: ColumnLike) -> Column:
    """Forward shadow of an object and the height recovered from it."""
    a = F.greatest(dbl(altitude_m), F.lit(0.1))
    x = F.greatest(dbl(ground_m), F.lit(0.1))
    cap = a * 0.9
    h = clamp(dbl(height_m), 0.0, cap)
    x_end = F.when(h <= 0, x).otherwise(x * a / (a - h))
    recovered = F.when(h <= 0, F.lit(0.0)).otherwise(a * (x_end - x) / x_end)
    return F.struct(
        half_even(h, 3).alias("height_m"),
        (F.abs(dbl(height_m) - h) > 1e-9).alias("height_clamped"),
        half_even(cap, 3).alias("max_height_m"),
        half_even(x, 3).alias("shadow_start_m"),
        half_even(x_end, 3).alias("shadow_end_m"),
        half_even(x_end - x, 3).alias("shadow_length_m"),
        half_even(recovered, 3).alias("recovered_height_m"),
        half_even(F.abs(recovered - h), 6).alias("round_trip_error_m"),
        half_even(F.degrees(F.atan2(a, x)), 2).alias("grazing_angle_deg"),
        F.when(h > 0, half_even((x_end - x) / h, 2)).alias("shadow_gain"),
    )


# ---- pixel <-> metres --------------------------------------------------------

def ground_range_of_col(c: ColumnLike, ground_res: ColumnLike) -> Column:
    return (dbl(c) + 0.5) * dbl(ground_res)


def col_of_ground_range(ground_m: ColumnLike, ground_res: ColumnLike) -> Column:
    return dbl(ground_m) / dbl(ground_res) - 0.5


def sample_to_slant(sample: ColumnLike, slant_res: ColumnLike) -> Column:
    return (dbl(sample) + 0.5) * dbl(slant_res)


def altitude_samples(altitude_m: ColumnLike, slant_res: ColumnLike) -> Column:
    return F.when(dbl(slant_res) > 0, dbl(altitude_m) / dbl(slant_res)).otherwise(0.0)


def to_slant_sample(c: ColumnLike, altitude_m: ColumnLike, ground_res: ColumnLike, slant_res: ColumnLike) -> Column:
    g, a = ground_range_of_col(c, ground_res), dbl(altitude_m)
    return F.sqrt(g * g + a * a) / dbl(slant_res) - 0.5


def to_ground_col(sample: ColumnLike, altitude_m: ColumnLike, ground_res: ColumnLike, slant_res: ColumnLike) -> Column:
    """NULL inside the water column."""
    r, a = sample_to_slant(sample, slant_res), dbl(altitude_m)
    under = r * r - a * a
    return F.when(under >= 0, col_of_ground_range(F.sqrt(under), ground_res))


# ---- waterfall (port mirrored, then starboard) -------------------------------

def waterfall_row(port: ColumnLike, starboard: ColumnLike) -> Column:
    return F.concat(F.reverse(col(port)), col(starboard))


def waterfall_col(side: ColumnLike, sample: ColumnLike, n_port: ColumnLike, n_starboard: ColumnLike) -> Column:
    """Waterfall column of a sample; NULL when the sample is out of range."""
    side, s, n_p, n_s = col(side), col(sample), col(n_port), col(n_starboard)
    return (F.when((side == "port") & (s >= 0) & (s < n_p), n_p - 1 - s)
            .when((side == "starboard") & (s >= 0) & (s < n_s), n_p + s))


def waterfall_sample(c: ColumnLike, n_port: ColumnLike, n_starboard: ColumnLike) -> Column:
    c, n_p, n_s = col(c), col(n_port), col(n_starboard)
    inside = (c >= 0) & (c < n_p + n_s)
    return F.when(inside, F.struct(
        F.when(c < n_p, F.lit("port")).otherwise(F.lit("starboard")).alias("side"),
        F.when(c < n_p, n_p - 1 - c).otherwise(c - n_p).alias("sample")))


# ---- targets -> boxes --------------------------------------------------------

def truth_box(ping: ColumnLike, ground_m: ColumnLike, length_m: ColumnLike, width_m: ColumnLike,
              step_m: ColumnLike, ground_res: ColumnLike, n_rows: ColumnLike, n_cols: ColumnLike,
              pad_cols: int = 3) -> Column:
    """Continuous (r0, r1, c0, c1) of a target; NULL when it lies off the image."""
    half = F.greatest(dbl(length_m) / (2.0 * dbl(step_m)), F.lit(1.0))
    p, g, w, res = dbl(ping), dbl(ground_m), dbl(width_m), dbl(ground_res)
    r0 = clamp(p + 0.5 - half, 0.0, dbl(n_rows))
    r1 = clamp(p + 0.5 + half, 0.0, dbl(n_rows))
    c0 = clamp((g - w / 2) / res, 0.0, dbl(n_cols))
    c1 = clamp((g + w / 2) / res + float(pad_cols), 0.0, dbl(n_cols))
    return F.when((r1 > r0) & (c1 > c0), F.struct(
        r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")))


def inclusive_box(box: ColumnLike) -> Column:
    """Continuous box -> inclusive integer extents."""
    b = col(box)
    t = lambda f: F.floor(b[f]).cast("int")  # noqa: E731 - extents are non-negative
    return F.when(b.isNotNull(), F.struct(
        t("r0").alias("ping0"), F.greatest(t("r1") - 1, t("r0")).alias("ping1"),
        t("c0").alias("col0"), F.greatest(t("c1") - 1, t("c0")).alias("col1")))
