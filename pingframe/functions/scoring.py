"""Confidence, physics gate, severity, triage and position budget."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .columns import ColumnLike, clamp, col, dbl, half_even, lookup
from .geometry import sound_speed_range_error

EPS = 1e-6


# ---- calibration -------------------------------------------------------------

def logit(p: ColumnLike) -> Column:
    q = clamp(dbl(p), EPS, 1.0 - EPS)
    return F.ln(q / (1.0 - q))


def sigmoid(z: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-dbl(z)))


def calibrated(score: ColumnLike, temperature=K.SCORING["temperature"]) -> Column:
    return sigmoid(logit(score) / dbl(temperature))


def confidence_pct(score: ColumnLike, multiplier: ColumnLike, temperature=K.SCORING["temperature"]) -> Column:
    return half_even(100.0 * clamp(calibrated(score, temperature) * dbl(multiplier), 0.0, 1.0), 1)


# ---- physics gate ------------------------------------------------------------

def physics_gate(cls: ColumnLike, has_highlight: ColumnLike, has_shadow: ColumnLike, height_m: ColumnLike,
                 scoring: dict = K.SCORING, bands: dict = K.HEIGHT_BANDS) -> Column:
    """struct(multiplier, violation, reason) from the acoustic cues."""
    cls, h = col(cls), dbl(height_m)
    lo, hi = lookup({k: v[0] for k, v in bands.items()}, cls), lookup({k: v[1] for k, v in bands.items()}, cls)
    band_text = lookup({k: K.REASONS["band"].format(float(v[0]), float(v[1])) for k, v in bands.items()}, cls)
    no_light = ~col(has_highlight)
    no_height = ~col(has_shadow) | h.isNull()
    outside = F.coalesce((h < lo) | (h > hi), F.lit(False))
    return F.struct(
        F.when(no_light, F.lit(scoring["no_highlight"])).when(no_height, F.lit(scoring["no_shadow"]))
        .when(outside, F.lit(scoring["violation"])).otherwise(F.lit(scoring["both_cues"])).alias("multiplier"),
        (~no_light & ~no_height & outside).alias("violation"),
        F.when(no_light, F.lit(K.REASONS["no_highlight"]))
        .when(no_height, F.lit(K.REASONS["no_height"]))
        .when(outside, F.format_string(K.REASONS["outside"], h, cls, band_text)).alias("reason"),
    )


def demote_thin(gate: ColumnLike, ping0: ColumnLike, ping1: ColumnLike, scoring: dict = K.SCORING) -> Column:
    """A box of too few pings is demoted with the reason appended, never dropped."""
    g, n, need = col(gate), col(ping1) - col(ping0) + 1, scoring["min_pings"]
    thin = n < need
    note = F.format_string(K.REASONS["thin"], n, F.lit(need))
    return F.struct(
        F.when(thin, g["multiplier"] * scoring["thin"]).otherwise(g["multiplier"]).alias("multiplier"),
        g["violation"].alias("violation"),
        F.when(thin, F.concat_ws("; ", g["reason"], note)).otherwise(g["reason"]).alias("reason"))


def verifier_factor(p: ColumnLike, scoring: dict = K.SCORING) -> Column:
    """Neutral when the verifier did not run."""
    f = clamp(scoring["verifier_floor"] + scoring["verifier_gain"] * dbl(p), scoring["verifier_lo"], scoring["verifier_hi"])
    return F.coalesce(f, F.lit(1.0))


# ---- detector scores ---------------------------------------------------------

def snr_score(mean: ColumnLike, background: ColumnLike, spread: ColumnLike, half_snr: float = 6.0) -> Column:
    sd = F.when(dbl(spread) == 0, F.lit(1e-6)).otherwise(dbl(spread))
    snr = F.greatest((dbl(mean) - dbl(background)) / sd, F.lit(0.0))
    return snr / (snr + half_snr)


def anomaly_score(peak: ColumnLike, threshold: ColumnLike, scale: float = 2.0) -> Column:
    return F.least(F.try_divide(dbl(peak), dbl(threshold)) / scale, F.lit(0.99))


# ---- severity ----------------------------------------------------------------

def severity_terms(cls: ColumnLike, area_m2: ColumnLike, height_m: ColumnLike, depth_m: ColumnLike,
                   proximity: ColumnLike, hazard: ColumnLike | None = None, area_scale=K.SEVERITY_SCALES["area_m2"], height_scale=K.SEVERITY_SCALES["height_m"],
                   shallow=K.SEVERITY_SCALES["shallow_m"], deep=K.SEVERITY_SCALES["deep_m"]) -> Column:
    """Unrounded struct(hazard, size, height, depth, proximity), each in 0..1."""
    h, d = dbl(height_m), dbl(depth_m)
    fallback = K.HAZARD.get(K.ANOMALY_CLASS, 0.5)
    haz = lookup(K.HAZARD, cls, fallback) if hazard is None else F.coalesce(dbl(hazard), F.lit(fallback))
    return F.struct(
        haz.alias("hazard"),
        (1.0 - F.exp(-F.greatest(dbl(area_m2), F.lit(0.0)) / area_scale)).alias("size"),
        F.when(h.isNull(), F.lit(K.SEVERITY_SCALES["no_height"])).otherwise(1.0 - F.exp(-F.greatest(h, F.lit(0.0)) / height_scale)).alias("height"),
        F.when(d.isNull(), F.lit(K.SEVERITY_SCALES["no_depth"])).when(d <= shallow, F.lit(1.0)).when(d >= deep, F.lit(K.SEVERITY_SCALES["deep"]))
        .otherwise(1.0 - (1.0 - K.SEVERITY_SCALES["deep"]) * (d - shallow) / (deep - shallow)).alias("depth"),
        F.coalesce(dbl(proximity), F.lit(0.0)).alias("proximity"))


def severity_total(terms: ColumnLike, weights: dict = K.SEVERITY_WEIGHTS) -> Column:
    t = col(terms)
    total = sum((w * t[name] for name, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return half_even(100.0 * clamp(total, 0.0, 1.0), 1)


def severity_breakdown(terms: ColumnLike) -> Column:
    t = col(terms)
    return F.struct(*[half_even(t[n], 3).alias(n) for n in ("hazard", "size", "height", "depth", "proximity")])


def _band(score: ColumnLike, pick) -> Column:
    s, expr = dbl(score), None
    for band in K.SEVERITY_BANDS:
        expr = F.when(s >= band[0], F.lit(pick(band))) if expr is None else expr.when(s >= band[0], F.lit(pick(band)))
    return expr.otherwise(F.lit(pick(K.SEVERITY_BANDS[-1])))


def severity_band(score: ColumnLike) -> Column:
    return _band(score, lambda b: b[1])


def band_colour(score: ColumnLike) -> Column:
    return _band(score, lambda b: b[2])


def priority(score: ColumnLike) -> Column:
    return _band(score, lambda b: K.PRIORITY_BY_BAND[b[1]])


# ---- recommended action ------------------------------------------------------

def recommend(cls: ColumnLike, severity: ColumnLike, depth_m: ColumnLike, layer_kind: ColumnLike,
              layer_distance_m: ColumnLike, rules=K.ACTION_RULES, thresholds=K.ACTION_THRESHOLDS) -> Column:
    """struct(action, rule, requires): the most specific instruction that applies."""
    cls = col(cls)
    table = {r[0]: dict(zip(K.ACTION_COLUMNS, r)) for r in rules}
    known = F.when(cls.isin(*table), cls).otherwise(F.lit(K.ANOMALY_CLASS))

    def text(field):
        return lookup({k: v[field] for k, v in table.items() if v[field] is not None}, known) \
            if any(v[field] is not None for v in table.values()) else F.lit(None).cast("string")

    always = known.isin(*[k for k, v in table.items() if v["always_override"]])
    base, near, high = text("base"), text("near_zone"), text("high_severity")
    deep, shallow = text("deep"), text("shallow")
    authority = lookup(K.ZONE_AUTHORITIES, layer_kind, K.DEFAULT_AUTHORITY)
    kind, dist, depth = col(layer_kind), dbl(layer_distance_m), dbl(depth_m)
    in_zone = kind.isNotNull() & (kind != "") & (dist < thresholds["zone_radius_m"]) & near.isNotNull()
    severe = (dbl(severity) >= thresholds["high_severity_at"]) & high.isNotNull()
    is_deep = (depth > thresholds["deep_m"]) & deep.isNotNull()
    is_shallow = (depth < thresholds["shallow_m"]) & shallow.isNotNull()
    rule = (F.when(always, F.lit("always_override")).when(in_zone, F.lit("near_sensitive_zone"))
            .when(severe, F.lit("high_severity")).when(is_deep, F.lit("deep"))
            .when(is_shallow, F.lit("shallow")).otherwise(F.lit("base")))
    action = (F.when(always, base).when(in_zone, F.replace(near, F.lit("{zone_authority}"), authority))
              .when(severe, high).when(is_deep, deep).when(is_shallow, shallow).otherwise(base))
    return F.struct(action.alias("action"), rule.alias("rule"), text("requires").alias("requires"))


# ---- position budget, cross-view ---------------------------------------------

def position_accuracy(ground_res: ColumnLike, layback_known: ColumnLike, ground_m: ColumnLike = 0.0,
                      nav_m=K.NAV_UNCERTAINTY_M, layback_m=K.LAYBACK_UNCERTAINTY_M, sv_frac=0.0) -> Column:
    known = F.lit(layback_known) if isinstance(layback_known, bool) else col(layback_known)
    return (2.0 * dbl(ground_res) + F.when(known, F.lit(0.0)).otherwise(F.lit(float(layback_m)))
            + dbl(nav_m) + sound_speed_range_error(ground_m, sv_frac))


def confirmed_confidence(conf: ColumnLike, boost: float = 1.15) -> Column:
    return F.least(dbl(conf) * boost, F.lit(100.0))


def unconfirmed_confidence(conf: ColumnLike, demote: float = 0.85) -> Column:
    return F.greatest(dbl(conf) * demote, F.lit(1.0))


def proximity_contribution(weight: ColumnLike, distance_m: ColumnLike, decay_m: float = 2000.0) -> Column:
    return dbl(weight) * F.exp(-dbl(distance_m) / decay_m)


def nll_term(z: ColumnLike, correct: ColumnLike, temperature) -> Column:
    """One row's negative log-likelihood at a temperature; average it."""
    p = clamp(sigmoid(dbl(z) / dbl(temperature)), EPS, 1.0 - EPS)
    c = dbl(correct)
    return -(c * F.ln(p) + (1.0 - c) * F.ln(1.0 - p))


def calibration_bin(score: ColumnLike, n_bins: int = 10) -> Column:
    """Bins are (lo, hi]; a score of 0 or above 1 falls in none."""
    edges = [i / n_bins for i in range(n_bins + 1)]
    s, expr = dbl(score), None
    for i in range(n_bins):
        hit = (s > edges[i]) & (s <= edges[i + 1])
        expr = F.when(hit, F.lit(i)) if expr is None else expr.when(hit, F.lit(i))
    return expr


def default_grid(lo: float, hi: float, n: int) -> list[float]:
    """Log-spaced grid with both ends included."""
    return [math.exp(math.log(lo) + (math.log(hi) - math.log(lo)) * i / (n - 1)) for i in range(n)]
