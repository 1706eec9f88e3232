"""Signal conditioning over ping rows: bottom track, gain, ground range, speckle, contrast, tiles.

Tables: traces(survey, side, ping, samples), nav(survey, ping, ...), ground(survey, side, ping, cols).
Pings of a survey are dense from 0.  No-data is NULL.  Row-local array work and
2-D filters run as numpy inside Arrow tasks; Spark keys, blocks and shuffles them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp, col
from ..session import cut_lineage
from .scale import exact_percentiles, framed, interpolate_gaps, mirrored_blocks, ranked, salted_join

SIDE = ["survey", "side"]
BLOCK = 256          # pings per 2-D block
PIXELS = 1 << 20     # pixels of a block that shares look-up tables
MAD_TO_SIGMA = 1.4826
RAYLEIGH_CU = float(np.sqrt(4.0 / np.pi - 1.0))


# ---- geometry ----------------------------------------------------------------

def survey_geometry(traces: DataFrame, nav: DataFrame) -> DataFrame:
    """Per survey-side: n_pings, n_samples (modal width), slant_res (median range / samples)."""
    width = traces.groupBy(*SIDE).agg(F.mode(F.size("samples"), True).alias("n_samples"), F.count(F.lit(1)).alias("n_pings"))
    ranges = exact_percentiles(nav, ["survey"], "slant_range", {"_range": 0.5})
    return width.join(ranges, "survey").select(
        *SIDE, "n_pings", "n_samples", F.when(F.col("n_samples") > 0, F.col("_range") / F.col("n_samples")).otherwise(0.0).alias("slant_res"))


def fit_width(samples: Column | str, n: Column | str) -> Column:
    """Pad with zeros or truncate to n samples."""
    s, n = col(samples), col(n)
    return F.when(F.size(s) >= n, F.slice(s, F.lit(1), n)).otherwise(F.concat(s, F.array_repeat(F.lit(0.0), n - F.size(s))))


def _matrix(series: pd.Series) -> np.ndarray:
    """Rows of equal length as one float matrix; missing values as NaN."""
    return np.vstack([np.asarray(v, dtype=float) for v in series])


def _by_length(series: pd.Series):
    """Index groups of rows that share a length, so each group is one matrix."""
    lengths = series.map(len).to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n), int(n)


# ---- bottom track ------------------------------------------------------------

def _smooth3(m: np.ndarray) -> np.ndarray:
    p = np.pad(m, ((0, 0), (1, 1)), mode="symmetric")
    return (p[:, :-2] + p[:, 1:-1] + p[:, 2:]) / 3.0


@F.pandas_udf(T.DoubleType())
def water_noise(samples: pd.Series) -> pd.Series:
    """Median of the first smoothed samples: the water-column level of a ping."""
    out = np.full(len(samples), np.nan)
    for idx, n in _by_length(samples):
        if n:
            out[idx] = np.median(_smooth3(_matrix(samples.iloc[idx]))[:, :max(4, n // 64)], axis=1)
    return pd.Series(out)


def _first_run(min_run: int, noise_factor: float):
    @F.pandas_udf(T.IntegerType())
    def first(samples: pd.Series, noise: pd.Series, floor: pd.Series) -> pd.Series:
        out = np.full(len(samples), -1, dtype=np.int32)
        level = np.maximum(noise.to_numpy(float), floor.to_numpy(float)) * noise_factor
        for idx, n in _by_length(samples):
            if not n:
                continue
            above = _smooth3(_matrix(samples.iloc[idx])) > level[idx, None]
            run = above.copy()
            for k in range(1, min_run):                       # the end of the row counts as still above
                run &= np.concatenate([above[:, k:], np.repeat(above[:, -1:], min(k, n), axis=1)], axis=1)[:, :n]
            hit = run.any(axis=1)
            out[idx[hit]] = run[hit].argmax(axis=1)
        return pd.Series(out)
    return first


def first_returns(traces: DataFrame, noise_factor: float = 4.0, min_run: int = 3) -> DataFrame:
    """First sustained return per ping-side (-1: none) against the larger of ping noise and a survey-side floor."""
    noisy = traces.withColumn("_noise", water_noise("samples"))
    floor = exact_percentiles(noisy.select(*SIDE, "_noise"), SIDE, "_noise", {"_med": 0.5}).select(
        *SIDE, F.greatest(F.col("_med") * 0.1, F.lit(1e-6)).alias("_floor"))
    rows = salted_join(noisy, floor, SIDE, "ping")
    return rows.select(*SIDE, "ping", _first_run(min_run, noise_factor)("samples", "_noise", "_floor").alias("first"))


def track_bottom(traces: DataFrame, nav: DataFrame, geom: DataFrame, noise_factor: float = 4.0, min_run: int = 3,
                 smooth_pings: int = 15, max_dev_m: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(bottom: survey, ping, altitude_m, header_altitude_m, valid; first_return per ping-side).

    Both sides fuse to one altitude, spikes against a median-smoothed track are
    replaced by interpolation, a short mean smooths the rest; a survey without
    any valid return keeps its header altitude.
    """
    est = salted_join(first_returns(traces, noise_factor, min_run), geom.select(*SIDE, "slant_res"), SIDE, "ping")
    fused = est.groupBy("survey", "ping").agg(
        F.avg(F.when(F.col("first") >= 0, (F.col("first") + 0.5) * F.col("slant_res"))).alias("fused"))
    n = nav.groupBy("survey").agg(F.count(F.lit(1)).alias("n"))
    base = cut_lineage(nav.select("survey", "ping", F.col("altitude").alias("header_altitude_m"))
                       .join(fused, ["survey", "ping"], "left").join(n, "survey"))
    half, tail = max(3, smooth_pings), max(3, smooth_pings // 2)
    filled = interpolate_gaps(base, ["survey"], "ping", "fused", "_ref0")
    ref = framed(filled, ["survey"], "ping", "n", half // 2, (half - 1) // 2,
                 {"_ref": lambda w: F.percentile("_ref0", F.lit(0.5)).over(w)})
    judged = ref.withColumn("valid", F.coalesce(F.abs(F.col("fused") - F.col("_ref")) <= max_dev_m, F.lit(False)))
    kept = interpolate_gaps(judged.withColumn("_kept", F.when(F.col("valid"), F.col("fused"))), ["survey"], "ping", "_kept", "_track")
    smooth = framed(kept, ["survey"], "ping", "n", tail // 2, (tail - 1) // 2, {"_alt": lambda w: F.avg("_track").over(w)})
    bottom = cut_lineage(smooth.select("survey", "ping", F.coalesce("_alt", "header_altitude_m").alias("altitude_m"),
                                       "header_altitude_m", "valid"))
    sides = salted_join(bottom.select("survey", "ping", "altitude_m"), geom.groupBy("survey").agg(
        F.collect_list(F.struct("side", "slant_res", "n_samples")).alias("_s")), ["survey"], "ping")
    s = sides.select("survey", "ping", "altitude_m", F.explode("_s").alias("s"))
    fr = clamp(F.rint(F.col("altitude_m") / F.col("s.slant_res")).cast("int"), F.lit(0), F.col("s.n_samples") - 1)
    first = s.select("survey", F.col("s.side").alias("side"), "ping",
                     F.when(F.col("s.slant_res") > 0, fr).otherwise(0).alias("first_return"))
    return bottom, first


# ---- gain --------------------------------------------------------------------

def gain_bins(traces: DataFrame, first: DataFrame, n_bins: int = 256, nadir_guard: int = 8) -> DataFrame:
    """Median seabed intensity per survey-side range bin, and the survey-side median `target`."""
    rows = traces.join(first, [*SIDE, "ping"])
    n = F.size("samples")
    guard = F.greatest(F.col("first_return"), F.lit(0)) + nadir_guard
    # only seabed samples leave the row
    px = rows.select(*SIDE, n.alias("n"), guard.alias("g"), F.posexplode("samples").alias("c", "v")).where(
        (F.col("c") >= F.col("g")) & F.col("v").isNotNull())
    nb = F.least(F.lit(n_bins), F.col("n"))
    px = px.select(*SIDE, F.floor(F.col("c") * nb / F.col("n")).cast("int").alias("bin"), "v")
    shape = traces.groupBy(*SIDE).agg(F.sum(F.size("samples").cast("long")).alias("px"), F.max(F.size("samples")).alias("n")).agg(
        F.max(F.ceil(F.col("px") / F.least(F.lit(n_bins), F.col("n")))).alias("b"), F.max("px").alias("t")).first()
    bins = exact_percentiles(px, [*SIDE, "bin"], "v", {"bin_median": 0.5}, group_rows=int(shape["b"] or 0))
    target = exact_percentiles(px, SIDE, "v", {"target": 0.5}, group_rows=int(shape["t"] or 0))
    return bins.join(target, SIDE)


def gain_curves(bins: DataFrame, geom: DataFrame, n_bins: int = 256, eps_frac: float = 0.01) -> DataFrame:
    """One gain array per survey-side: bins interpolated to samples, dead bins clamped; degenerate sides get ones."""
    packed = bins.groupBy(*SIDE).agg(F.first("target").alias("target"), F.collect_list("bin").alias("b"),
                                     F.collect_list("bin_median").alias("m"))          # at most n_bins entries
    rows = geom.select(*SIDE, "n_samples").join(packed, SIDE, "left")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def curve(n: pd.Series, target: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for size, t, bb, mm in zip(n, target, b, m):
            gain = np.ones(int(size))
            if bb is not None and len(bb) and np.isfinite(t) and t > 0:
                k = min(n_bins, int(size))
                edge = np.searchsorted(np.arange(int(size)) * k // int(size), np.arange(k + 1))
                centre = (edge[:-1] + edge[1:] - 1) / 2.0
                o = np.argsort(bb)
                at, med = centre[np.asarray(bb)[o]], np.asarray(mm, dtype=float)[o]
                filled = np.interp(centre, at, med)
                g = np.interp(np.arange(int(size), dtype=float), centre, filled / t)
                mid = np.median(g)
                if np.isfinite(mid) and mid > 0:
                    gain = np.maximum(g, eps_frac * mid)
            out.append(gain)
        return pd.Series(out)

    return rows.select(*SIDE, curve("n_samples", "target", "b", "m").alias("gain"))


def normalise_gain(samples: Column | str, gain: Column | str, first_return: Column | str) -> Column:
    """Samples divided by the gain from the first return on; water column untouched."""
    fr, g = col(first_return), col(gain)
    return F.transform(col(samples), lambda v, i: F.when(i < fr, v).otherwise(v / F.get(g, i)))


# ---- slant to ground ---------------------------------------------------------

def ground_grid(geom: DataFrame, bottom: DataFrame, ground_res: float | None = None) -> DataFrame:
    """Adds ground_res (finest side unless given) and n_cols (widest swath of the survey) per survey-side; n_pings are the survey's."""
    finest = geom.groupBy("survey").agg(F.min(F.when(F.col("slant_res") > 0, F.col("slant_res"))).alias("_res"))
    low = bottom.groupBy("survey").agg(F.min("altitude_m").alias("_alt"), (F.max("ping") + 1).cast("long").alias("n_pings"))
    g = geom.drop("n_pings").join(finest, "survey").join(low, "survey")
    res = F.col("_res") if ground_res is None else F.lit(float(ground_res))
    reach = F.col("n_samples") * F.col("slant_res")
    wide = F.sqrt(F.greatest(reach * reach - F.col("_alt") * F.col("_alt"), F.lit(0.0)))
    return g.select(*geom.columns, res.alias("ground_res"), F.floor(wide / res).cast("int").alias("n_cols"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ground_row(samples: pd.Series, first_return: pd.Series, altitude: pd.Series, slant_res: pd.Series,
               ground_res: pd.Series, n_cols: pd.Series) -> pd.Series:
    """One ping resampled to uniform ground range; NULL before the first return and beyond the swath."""
    out = []
    for s, fr, a, sr, gr, n in zip(samples, first_return, altitude, slant_res, ground_res, n_cols):
        s = np.asarray(s, dtype=float)
        at = np.hypot((np.arange(int(n)) + 0.5) * gr, a) / sr - 0.5
        row = np.interp(at, np.arange(len(s)), s) if len(s) else np.full(int(n), np.nan)
        bad = ~((at <= len(s) - 1) & (at >= fr)) | ~np.isfinite(row)
        out.append([None if b else v for v, b in zip(row.tolist(), bad.tolist())] if bad.any() else row)
    return pd.Series(out)


def slant_to_ground(traces: DataFrame, first: DataFrame, bottom: DataFrame, grid: DataFrame) -> DataFrame:
    """Every ping of a survey on each of its sides; one whose record is lost on a side is a line without data there."""
    lines = salted_join(bottom.select("survey", "ping", "altitude_m"), grid.select(*SIDE, "slant_res", "ground_res", "n_cols"), ["survey"], "ping")
    rows = lines.join(traces.select(*SIDE, "ping", "samples").join(first, [*SIDE, "ping"]), [*SIDE, "ping"], "left")
    rows = rows.withColumns({"samples": F.coalesce("samples", F.array().cast("array<double>")), "first_return": F.coalesce("first_return", F.lit(0))})
    return rows.select(*SIDE, "ping", ground_row("samples", "first_return", "altitude_m", "slant_res", "ground_res", "n_cols").alias("cols"))


# ---- 2-D filters on blocks ---------------------------------------------------

def _blocks(ground: DataFrame, halo: int, n_pings: DataFrame, block: int) -> DataFrame:
    rows = salted_join(ground, n_pings.select(*SIDE, F.col("n_pings").alias("_n")), SIDE, "ping")
    return mirrored_blocks(rows, SIDE, "ping", "_n", halo, block)


def _nulls(m: np.ndarray) -> list:
    """Matrix rows as lists with None for NaN (Arrow writes them as NULL)."""
    bad = ~np.isfinite(m)
    return [np.where(b, None, r.astype(object)).tolist() if b.any() else r.tolist() for r, b in zip(m, bad)]


def _on_blocks(blocks: DataFrame, fn, out: dict[str, str]) -> DataFrame:
    """Run fn(matrix) -> dict of matrices on every block; only rows the block owns come back."""
    schema = "survey string, side string, ping int, " + ", ".join(f"{k} {t}" for k, t in out.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_q", ignore_index=True)
        res = fn(_matrix(pdf["cols"]), pdf["_q"].to_numpy(), int(pdf["_n"].iloc[0]))
        own = pdf["_own"].to_numpy(bool)
        rows = {k: (_nulls(v[own]) if v.dtype != bool else [r.tolist() for r in v[own]]) for k, v in res.items()}
        return pd.DataFrame({"survey": pdf["survey"][own].to_numpy(), "side": pdf["side"][own].to_numpy(),
                             "ping": pdf["ping"][own].astype(np.int32).to_numpy(), **rows})

    return blocks.groupBy(*SIDE, "_blk").applyInPandas(run, schema)


def _box_sum(m: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums over `size` neighbours along an axis of an already padded matrix."""
    c = np.cumsum(m, axis=axis)
    c = np.concatenate([np.zeros_like(np.take(c, [0], axis=axis)), c], axis=axis)
    n = m.shape[axis] - size + 1
    return np.take(c, np.arange(size, size + n), axis=axis) - np.take(c, np.arange(n), axis=axis)


def local_stats(ground: DataFrame, n_pings: DataFrame, size: int = 5, block: int = BLOCK) -> DataFrame:
    """Mean and variance over size x size valid neighbours per pixel (`mu`, `var`; NULL where none is valid)."""
    h = size // 2

    def stats(m, q, n):
        ok = np.isfinite(m)
        # rows come mirrored with the block; at a block's outer halo the sums are not used
        pad = lambda x: np.pad(np.pad(x, ((h, h), (0, 0)), mode="edge"), ((0, 0), (h, h)), mode="symmetric")
        both = lambda x: _box_sum(_box_sum(pad(x), size, 0), size, 1)
        z = np.where(ok, m, 0.0)
        w = both(ok.astype(float))
        with np.errstate(invalid="ignore", divide="ignore"):
            mu = np.where(w > 0.5, both(z) / w, np.nan)
            var = np.maximum(both(z * z) / w - mu * mu, 0.0)
        return {"cols": m, "mu": mu, "var": var}

    return _on_blocks(_blocks(ground, h, n_pings, block), stats, {"cols": "array<double>", "mu": "array<double>", "var": "array<double>"})


def speckle_level(stats: DataFrame, pixels: int | None = None) -> DataFrame:
    """Median local coefficient of variation per survey-side."""
    cv = stats.select(*SIDE, F.explode(F.zip_with("mu", "var", lambda m, v: F.when(m != 0, F.sqrt(v) / m))).alias("cv"), )
    return exact_percentiles(cv, SIDE, "cv", {"cu": 0.5}, group_rows=pixels).select(*SIDE, F.coalesce("cu", F.lit(RAYLEIGH_CU)).alias("cu"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lee_blend(cols: pd.Series, mu: pd.Series, var: pd.Series, cu: pd.Series) -> pd.Series:
    out = []
    for x, m, v, c in zip(cols, mu, var, cu):
        x, m, v, c2 = (np.asarray(x, dtype=float), np.asarray(m, dtype=float), np.asarray(v, dtype=float), c * c)
        signal = np.maximum(v - c2 * m * m, 0.0) / (1.0 + c2)
        total = signal + c2 * (m * m + signal)
        with np.errstate(invalid="ignore", divide="ignore"):
            y = m + np.where(total > 0, signal / total, 0.0) * (x - m)
        out.append(_nulls(y[None, :])[0])
    return pd.Series(out)


def lee_filter(ground: DataFrame, n_pings: DataFrame, size: int = 5, cu: float | None = None, block: int = BLOCK) -> DataFrame:
    """Speckle filter: pixels move to the local mean where the local contrast is only noise."""
    stats = local_stats(ground, n_pings, size, block)
    if cu is None:
        stats = cut_lineage(stats)
        level = speckle_level(stats, _pixel_bound(ground))
        rows = salted_join(stats, level, SIDE, "ping")
    else:
        rows = stats.withColumn("cu", F.lit(float(cu)))
    return rows.select(*SIDE, "ping", _lee_blend("cols", "mu", "var", "cu").alias("cols"))


def _pixel_bound(ground: DataFrame) -> int:
    return int(ground.groupBy(*SIDE).agg(F.sum(F.size("cols").cast("long")).alias("n")).agg(F.max("n")).first()[0] or 0)


def _window_median(m: np.ndarray, size: int) -> np.ndarray:
    h = size // 2
    p = np.pad(np.pad(m, ((h, h), (0, 0)), mode="edge"), ((0, 0), (h, h)), mode="symmetric")
    out = np.empty_like(m)
    for r in range(0, len(m), 32):                            # strips bound the memory of the window view
        part = p[r:r + min(32, len(m) - r) + 2 * h]
        view = np.lib.stride_tricks.sliding_window_view(part, (size, size))
        flat = np.sort(view.reshape(*view.shape[:2], -1), axis=-1)
        out[r:r + len(view)] = flat[..., size * size // 2]
    return out


def impulse_median(ground: DataFrame, n_pings: DataFrame, size: int = 3, threshold: float = 3.0, mad_size: int | None = None,
                   block: int = BLOCK) -> DataFrame:
    """Isolated spikes replaced by the local median; everything else unchanged."""
    mad_size = mad_size or 2 * size + 1
    px = ground.select(*SIDE, F.explode("cols").alias("v"))
    fill = exact_percentiles(px, SIDE, "v", {"_fill": 0.5}, group_rows=_pixel_bound(ground))
    rows = salted_join(ground, fill, SIDE, "ping")
    filled = rows.select(*SIDE, "ping", F.transform("cols", lambda v: F.coalesce(v, F.col("_fill"))).alias("cols"),
                         F.transform("cols", lambda v: v.isNotNull()).alias("_ok"))

    def clean(m, q, n):
        med = _window_median(m, size)
        mad = _window_median(np.abs(m - med), mad_size)
        return {"cols": np.where(np.abs(m - med) > threshold * MAD_TO_SIGMA * mad, med, m)}

    halo = size // 2 + mad_size // 2
    out = _on_blocks(_blocks(filled.drop("_ok"), halo, n_pings, block), clean, {"cols": "array<double>"})
    back = out.join(filled.select(*SIDE, "ping", "_ok"), [*SIDE, "ping"])
    return back.select(*SIDE, "ping", F.zip_with("cols", "_ok", lambda v, ok: F.when(ok, v)).alias("cols"))


METHODS = {"lee": lee_filter, "median": impulse_median, "adaptive_median": impulse_median}


def despeckle(ground: DataFrame, n_pings: DataFrame, method: str = "lee", **kw) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown despeckle method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](ground, n_pings, **kw)


def open_mask(mask: DataFrame, n_pings: DataFrame, radius: int = 1, block: int = BLOCK) -> DataFrame:
    """Binary opening (erode, then dilate) of boolean rows; everything outside the image is FALSE."""
    if radius <= 0:
        return mask
    size = 2 * radius + 1

    def opened(m, q, n):
        b = m > 0.5
        b[(q < 0) | (q >= n)] = False
        count = lambda x: _box_sum(_box_sum(np.pad(x.astype(np.int64), radius), size, 0), size, 1)
        core = count(b) == size * size
        core[(q < 0) | (q >= n)] = False
        return {"mask": count(core) > 0}

    as_cols = mask.select(*SIDE, "ping", F.transform("mask", lambda v: F.coalesce(v, F.lit(False)).cast("double")).alias("cols"))
    return _on_blocks(_blocks(as_cols, 2 * radius, n_pings, block), opened, {"mask": "array<boolean>"})


# ---- contrast ----------------------------------------------------------------

def stretch_limits(ground: DataFrame, p_low: float = 1.0, p_high: float = 99.5, pixels: int | None = None) -> DataFrame:
    px = ground.select(*SIDE, F.explode("cols").alias("v"))
    return exact_percentiles(px, SIDE, "v", {"lo": p_low / 100.0, "hi": p_high / 100.0}, group_rows=pixels)


def stretch_u8(ground: DataFrame, p_low: float = 1.0, p_high: float = 99.5) -> DataFrame:
    """8-bit quick-look rows; no-data is 0."""
    lim = stretch_limits(ground, p_low, p_high, _pixel_bound(ground)).withColumn(
        "hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    rows = salted_join(ground, lim, SIDE, "ping")
    byte = lambda v: F.floor(clamp((v - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0) * 255.0 + 0.5).cast("int")
    return rows.select(*SIDE, "ping", F.transform("cols", lambda v: F.coalesce(byte(v), F.lit(0))).alias("cols"))


def _reflected(n: int, padded: int) -> np.ndarray:
    """Source index of every padded position, mirrored without repeating the last one."""
    i = np.arange(padded)
    if n == 1:
        return np.zeros(padded, dtype=int)
    period = 2 * (n - 1)
    i = i % period
    return np.where(i < n, i, period - i)


def equalise(ground: DataFrame, n_pings: DataFrame, clip_limit: float = 2.5, tile_grid: tuple[int, int] = (8, 8),
             p_low: float = 1.0, p_high: float = 99.7, block: int = BLOCK) -> DataFrame:
    """Contrast-limited equalisation to 0..1: 16-bit codes, a clipped histogram per grid cell, bilinear blend.

    `tile_grid` is (cells across range, cells along track).  Flat images become
    0.5, no-data stays NULL.  Histograms are counted per (cell, code) map-side.
    Pings between the same two rows of cells go together, `PIXELS` pixels (and
    `block` pings) at a time, so a curve is sent no more often than it is worth.
    """
    lim = stretch_limits(ground, p_low, p_high, _pixel_bound(ground))
    shape = n_pings.select(*SIDE, F.col("n_pings").alias("_n"))
    rows = salted_join(salted_join(ground, lim, SIDE, "ping"), shape, SIDE, "ping")
    top = 65535.0
    code = F.transform("cols", lambda v: F.rint(clamp((F.coalesce(v, F.col("lo")) - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0) * top).cast("int"))
    flat = ~(F.col("hi") > F.col("lo")) | F.col("hi").isNull()
    coded = rows.select(*SIDE, "ping", "cols", "_n", F.size("cols").alias("_m"), flat.alias("_flat"), F.when(~flat, code).alias("code"))
    seen = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    shown = F.when(F.col("_flat"), F.transform("cols", lambda v: F.when(seen(v), F.lit(0)))).otherwise(
        F.zip_with("code", "cols", lambda k, v: F.when(seen(v), k)))
    gx = F.greatest(F.least(F.lit(tile_grid[0]), F.col("_m")), F.lit(1))
    gy = F.greatest(F.least(F.lit(tile_grid[1]), F.col("_n").cast("int")), F.lit(1))
    coded = coded.withColumns({"_gx": gx, "_gy": gy})
    coded = coded.withColumns({"_th": F.ceil(F.col("_n") / F.col("_gy")).cast("int"), "_tw": F.ceil(F.col("_m") / F.col("_gx")).cast("int")})
    live = coded.where(~F.col("_flat"))
    # pixels of the mirrored margin that fills the last cells are counted again
    ph, pw = F.col("_th") * F.col("_gy"), F.col("_tw") * F.col("_gx")
    mirror = lambda i, n, padded: F.filter(F.array(i, F.when((2 * (n - 1) - i >= n) & (2 * (n - 1) - i < padded), 2 * (n - 1) - i)),
                                           lambda k: k.isNotNull())
    px = live.select(*SIDE, "_n", "_m", "_th", "_tw", "_gy", "_gx", pw.alias("_pw"),
                     F.explode(mirror(F.col("ping").cast("long"), F.col("_n"), ph.cast("long"))).alias("_r"),
                     "code").select("*", F.posexplode("code").alias("_j", "k")).drop("code")
    px = px.withColumn("_c", F.explode(mirror(F.col("_j"), F.col("_m"), F.col("_pw"))))
    hist = px.groupBy(*SIDE, F.floor(F.col("_r") / F.col("_th")).cast("int").alias("_cy"),
                      F.floor(F.col("_c") / F.col("_tw")).cast("int").alias("_cx"), "_th", "_tw", "k").agg(F.count(F.lit(1)).alias("n"))
    # one curve per cell: codes present, cumulative counts after clipping (at most 65536 entries)
    cell = hist.groupBy(*SIDE, "_cy", "_cx", "_th", "_tw").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("h"))
    area = (F.col("_th") * F.col("_tw")).cast("double")
    limit = F.greatest(F.floor(F.lit(float(clip_limit)) * area / 65536.0), F.lit(1)).cast("long")
    curve = cell.select(*SIDE, "_cy", "_cx", "_tw", F.transform("h", lambda e: e["k"]).alias("k"),
                        F.transform("h", lambda e: F.least(e["n"], limit)).alias("n"),
                        (area - F.aggregate("h", F.lit(0).cast("long"), lambda a, e: a + F.least(e["n"], limit)).cast("double")).cast("long").alias("excess"),
                        area.alias("area"))
    part = F.floor(F.col("ping") / F.greatest(F.lit(block), F.floor(PIXELS / F.greatest("_m", F.lit(1))))).alias("_blk")
    above = F.floor(F.col("ping").cast("double") / F.col("_th") - 0.5).cast("int").alias("_y")
    blocked = coded.select(*SIDE, "ping", "_flat", "_gy", "_gx", "_th", "_tw", above, part, shown.alias("code"))
    need = (live.select(*SIDE, above, part, "_gy").distinct()
            .select(*SIDE, "_blk", "_y", F.explode(F.array(clamp(F.col("_y"), F.lit(0), F.col("_gy") - 1), clamp(F.col("_y") + 1, F.lit(0), F.col("_gy") - 1))).alias("_cy")).distinct())
    curves = need.join(curve, [*SIDE, "_cy"])
    curves = curves.select(*[F.col(c).alias(c) for c in curves.columns])     # own column ids: both sides share a source

    def table(k, n, excess: int, a: float) -> np.ndarray:
        """The level of each of the 65,536 codes in a cell."""
        total = np.zeros(65536, dtype=np.int64)
        total[np.asarray(k)] = n
        codes, (each, left_over) = np.arange(65536), divmod(excess, 65536)
        total = np.cumsum(total) + each * (codes + 1)
        if left_over:
            total = total + np.minimum(codes // max(65536 // left_over, 1) + 1, left_over)
        return np.clip(np.rint(total * (top / a)), 0, top)

    def blend(rows: pd.DataFrame, codes: np.ndarray, levels: dict) -> np.ndarray:
        gy_, gx_, th, tw = (int(rows[c].iloc[0]) for c in ("_gy", "_gx", "_th", "_tw"))
        ty = rows["ping"].to_numpy() / th - 0.5
        y1 = int(rows["_y"].iloc[0])                                          # the same for all of a group
        fy = (ty - y1)[:, None]
        tx = np.arange(codes.shape[1]) / tw - 0.5
        x1 = np.floor(tx).astype(int)
        fx = tx - x1
        res = np.zeros(codes.shape)
        for y, wy in ((max(y1, 0), 1.0 - fy), (min(y1 + 1, gy_ - 1), fy)):
            for xs, wx in ((np.maximum(x1, 0), 1.0 - fx), (np.minimum(x1 + 1, gx_ - 1), fx)):
                for x in np.unique(xs):
                    sel = xs == x
                    res[:, sel] += wy * wx[sel] * levels[(y, int(x), tw)][codes[:, sel]]
        return np.rint(res) / top

    def apply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        levels = {(int(cy), int(cx), int(tw)): table(k, n, int(excess), float(a)) for cy, cx, tw, k, n, excess, a in
                  zip(right["_cy"], right["_cx"], right["_tw"], right["k"], right["n"], right["excess"], right["area"])}
        done = []
        for (_, flat_), rows in left.groupby([left["code"].str.len(), "_flat"], sort=False):
            m = _matrix(rows["code"])
            ok = np.isfinite(m)
            res = np.full(m.shape, 0.5) if flat_ else blend(rows, np.where(ok, m, 0).astype(np.int64), levels)
            done.append(pd.DataFrame({"survey": rows["survey"], "side": rows["side"], "ping": rows["ping"].astype(np.int32), "cols": _nulls(np.where(ok, res, np.nan))}))
        return pd.concat(done) if done else pd.DataFrame({"survey": [], "side": [], "ping": np.zeros(0, np.int32), "cols": []})

    return (blocked.groupBy(*SIDE, "_y", "_blk").cogroup(curves.groupBy(*SIDE, "_y", "_blk"))
            .applyInPandas(apply, "survey string, side string, ping int, cols array<double>"))


def scaled_rows(rows: int, window_pings: Column | str, total_pings: Column | str) -> Column:
    """Grid rows for a window so that a cell spans as many pings as in the whole survey."""
    return F.greatest(F.lit(1), F.rint(F.lit(float(rows)) * col(window_pings) / col(total_pings)).cast("int"))


# ---- tiles -------------------------------------------------------------------

def tile_origins(shape: DataFrame, tile: int = 512, overlap: float = 0.25) -> DataFrame:
    """Tiles of every survey-side from (n_pings, n_cols): row0, col0, h, w."""
    from ..functions.boxes import axis_origins
    stride = max(int(round(tile * (1.0 - overlap))), 1)
    t = shape.withColumn("row0", F.explode(axis_origins("n_pings", tile, stride))).withColumn("col0", F.explode(axis_origins("n_cols", tile, stride)))
    return t.select(*SIDE, "row0", "col0", F.least(F.lit(tile), F.col("n_pings").cast("int")).alias("h"),
                    F.least(F.lit(tile), F.col("n_cols").cast("int")).alias("w"))


def count_finite(ground: DataFrame, tiles: DataFrame, bucket: int = 256) -> DataFrame:
    """Adds n_finite per tile from ping rows (range join on ping, partial sums before the shuffle)."""
    from .joins import range_join
    t = tiles.withColumn("_r1", F.col("row0") + F.col("h") - 1)
    j = range_join(ground, t, SIDE, "ping", "row0", "_r1", bucket)
    n = F.size(F.filter(F.slice("cols", F.col("col0") + 1, F.col("w")), lambda v: v.isNotNull()))
    return j.groupBy(*SIDE, "row0", "col0", "h", "w").agg(F.sum(n).alias("n_finite"))


def tiles_of(ground: DataFrame, shape: DataFrame, tile: int = 512, overlap: float = 0.25, min_content: float = 0.0) -> DataFrame:
    """Kept tiles with running ids per survey: port first, then along track, then across."""
    t = count_finite(ground, tile_origins(shape, tile, overlap))
    kept = t.where((F.col("n_finite") > 0) & (F.col("n_finite") >= min_content * F.col("h") * F.col("w")))
    return ranked(kept, ["survey"], [F.asc("side"), F.asc("row0"), F.asc("col0")], "_r").withColumn("tile_index", F.col("_r") - 1).drop("_r")


def tile_rows(ground: DataFrame, tiles: DataFrame, bucket: int = 256) -> DataFrame:
    """Pixels of every tile as rows (tile_index, r, cols): the input of a model task."""
    from .joins import range_join
    t = tiles.withColumn("_r1", F.col("row0") + F.col("h") - 1)
    j = range_join(ground, t, SIDE, "ping", "row0", "_r1", bucket)
    return j.select(*SIDE, "tile_index", (F.col("ping") - F.col("row0")).alias("r"), F.slice("cols", F.col("col0") + 1, F.col("w")).alias("cols"))
