"""Acoustic shadows, verifier features and the classical blob detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.boxes import BOX
from ..functions.columns import clamp
from ..functions.geometry import is_multipath_candidate
from ..functions.scoring import confidence_pct, demote_thin, physics_gate, snr_score, verifier_factor
from ..session import cut_lineage
from .components import blobs, islands, row_runs
from .conditioning import SIDE, open_mask
from .filters import blob_filter
from .joins import range_join
from .scale import exact_percentiles, salted_join



def clip_boxes(dets: DataFrame, grid: DataFrame) -> DataFrame:
    """Boxes clipped to the image, with n_pings, n_cols and ground_res attached.

    Both sides of a survey show the same pings; a record that one side has lost does not shorten its image.
    """
    pings = grid.groupBy("survey").agg(F.max("n_pings").alias("n_pings"))
    d = salted_join(dets, grid.select(*SIDE, "n_cols", "ground_res").join(pings, "survey"), SIDE, "det_id")
    n, m = F.col("n_pings").cast("int"), F.col("n_cols").cast("int")
    d = d.withColumns({"ping0": clamp(F.col("ping0"), F.lit(0), n - 1), "col0": clamp(F.col("col0"), F.lit(0), m - 1)})
    return d.withColumns({"ping1": F.least(F.greatest(F.col("ping1"), F.col("ping0")), n - 1),
                          "col1": F.least(F.greatest(F.col("col1"), F.col("col0")), m - 1)})


def crop_rows(dets: DataFrame, ground: DataFrame, row_margin: int = 0, bucket: int = 64) -> DataFrame:
    """Ground rows under every box (+/- rows): a bucketed range join on ping, rows still as arrays.

    `dets` carries lo_col/hi_col: only that column span leaves the join.
    """
    d = dets.withColumns({"_p0": F.greatest(F.col("ping0") - row_margin, F.lit(0)), "_p1": F.col("ping1") + row_margin})
    j = range_join(ground.select(*SIDE, F.col("ping").alias("row"), "cols"), d, SIDE, "row", "_p0", "_p1", bucket)
    span = F.slice("cols", F.col("lo_col") + 1, F.greatest(F.col("hi_col") - F.col("lo_col") + 1, F.lit(0)))
    return j.withColumn("cols", span).drop("_p0", "_p1")


def shadow_reach(x_far: Column, altitude: Column, max_height: float) -> Column:
    """Ground range where the shadow of the tallest allowed object ends."""
    cap = F.when(altitude > 0, F.least(F.lit(max_height), 0.9 * altitude)).otherwise(F.lit(max_height))
    return F.when((altitude > 0) & (cap < altitude), x_far * altitude / F.nullif(altitude - cap, F.lit(0.0))).otherwise(x_far * 4.0)


def shadow_geometry(dets: DataFrame, altitude: DataFrame, cfg: dict = K.SHADOW, bucket: int = 64) -> DataFrame:
    """Mean altitude under the box, far edge, search limit and core rows per (clipped) box."""
    alt = range_join(altitude.select("survey", F.col("ping").alias("row"), "altitude_m"),
                     dets.select("survey", "det_id", "ping0", "ping1"), ["survey"], "row", "ping0", "ping1", bucket)
    d = dets.join(alt.groupBy("det_id").agg(F.avg("altitude_m").alias("altitude_m")), "det_id", "left")
    res = F.col("ground_res")
    d = d.withColumn("x_far_m", (F.col("col1") + 0.5) * res)
    reach = F.ceil(shadow_reach(F.col("x_far_m"), F.col("altitude_m"), cfg["max_height_m"]) / res - 0.5)
    n = F.col("ping1") - F.col("ping0") + 1
    margin = F.rint(n * ((1.0 - min(max(cfg["core_frac"], 0.1), 1.0)) / 2.0)).cast("int")
    margin = F.when(n - 2 * margin >= 1, margin).otherwise(0)
    near_hi = F.greatest(F.col("col0") - cfg["bg_gap"], F.lit(0))
    far_lo = F.least(F.col("col1") + cfg["bg_gap"], F.col("n_cols"))
    return d.withColumns({
        "search_hi": clamp(reach.cast("int"), F.col("col1") + 1, F.col("n_cols").cast("int")),
        "core0": F.col("ping0") + margin, "core1": F.col("ping1") - margin,
        "near_lo": F.greatest(near_hi - cfg["bg_width"], F.lit(0)), "near_hi": near_hi,
        "far_lo": far_lo, "far_hi": far_lo + cfg["bg_width"]}).withColumns({
            "lo_col": F.col("near_lo"),
            "hi_col": F.least(F.greatest(F.col("search_hi"), F.col("far_hi")) - 1, F.col("n_cols").cast("int") - 1)})


def _pixels(crop: DataFrame, *keep: str) -> DataFrame:
    return crop.select("det_id", "row", *keep, "lo_col", F.posexplode("cols").alias("_i", "v")).withColumn("col", F.col("lo_col") + F.col("_i"))


def _median(values: Column) -> Column:
    """Median of an array without nulls, as `percentile` gives it; NULL if it is empty."""
    v, n = F.sort_array(values), F.size(values)
    at = lambda i: F.get(v, F.floor(i / 2).cast("int"))
    return 0.5 * at(n - 1) + 0.5 * at(n)


def backgrounds(crop: DataFrame) -> DataFrame:
    """Box median and local seabed level (near side, else far side) per detection."""
    def strip(lo, hi):                                   # columns lo to hi - 1 of a row, as far as it has them
        first = F.greatest(lo - F.col("lo_col"), F.lit(0))
        return F.array_compact(F.slice("cols", first + 1, F.greatest(hi - F.col("lo_col") - first, F.lit(0))))

    strips = {"_near": strip(F.col("near_lo"), F.col("near_hi")), "_far": strip(F.col("far_lo"), F.col("far_hi")), "_box": strip(F.col("col0"), F.col("col1") + 1)}
    rows = crop.where(F.size("cols") > 0).groupBy("det_id").agg(*[F.flatten(F.collect_list(v)).alias(k) for k, v in strips.items()])       # groups are one box and its strips
    a = rows.select("det_id", *[_median(F.col(k)).alias(k) for k in strips])
    level = F.when(F.col("_near") > 0, F.col("_near")).when(F.col("_far") > 0, F.col("_far"))
    return a.select("det_id", level.alias("background"), F.col("_box").alias("box_median"))


def dark_columns(crop: DataFrame, levels: DataFrame, cfg: dict = K.SHADOW) -> DataFrame:
    """Share of dark rows per down-range column of the core rows."""
    core = crop.where(F.col("row").between(F.col("core0"), F.col("core1"))).join(levels, "det_id")
    px = _pixels(core, "col1", "search_hi", "background").where((F.col("col") > F.col("col1")) & (F.col("col") < F.col("search_hi")))
    dark = F.coalesce(F.col("v") < cfg["shadow_thresh"] * F.col("background"), F.lit(False))
    return px.groupBy("det_id", "col1", "col").agg(
        F.coalesce(F.try_divide(F.count_if(dark).cast("double"), F.count("v")), F.lit(0.0)).alias("dark_frac")).select(
        "det_id", (F.col("col") - F.col("col1") - 1).alias("j"), "dark_frac")


def shadow_runs(dark: DataFrame, cfg: dict = K.SHADOW) -> DataFrame:
    """First shadow run per detection: starts within the lead-in, short bright gaps allowed, two columns at least."""
    lit = islands(dark.where(F.col("dark_frac") >= cfg["min_dark_frac"]), ["det_id"], "j", cfg["tolerance"])
    runs = lit.groupBy("det_id", "island").agg(F.max("j").alias("run_end"))
    first = runs.groupBy("det_id").agg(F.min(F.struct("island", "run_end")).alias("r"))
    return first.where((F.col("r.island") < max(cfg["lead_in"], 1)) & (F.col("r.run_end") - F.col("r.island") >= 1)).select(
        "det_id", F.col("r.island").alias("run_start"), F.col("r.run_end").alias("run_end"))


def analyse_shadows(dets: DataFrame, ground: DataFrame, altitude: DataFrame, grid: DataFrame, cfg: dict = K.SHADOW) -> DataFrame:
    """Adds `analysis` (cues, ratios, lengths, height; NULL where unmeasured) to every detection."""
    return _analysed(dets, *_measured(dets, ground, altitude, grid, cfg), cfg)


def _measured(dets: DataFrame, ground: DataFrame, altitude: DataFrame, grid: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clipped boxes with their geometry, ground rows under them, seabed levels), each worked out once."""
    d = cut_lineage(shadow_geometry(clip_boxes(dets.select("det_id", *SIDE, *BOX), grid), altitude, cfg))
    crop = cut_lineage(crop_rows(d, ground))
    return d, crop, cut_lineage(backgrounds(crop))


def _analysed(dets: DataFrame, d: DataFrame, crop: DataFrame, levels: DataFrame, cfg: dict) -> DataFrame:
    usable = levels.where("background IS NOT NULL").select("det_id", "background")
    runs = cut_lineage(shadow_runs(dark_columns(crop, usable, cfg), cfg))
    core = crop.where(F.col("row").between(F.col("core0"), F.col("core1"))).join(runs, "det_id")
    j = F.col("col") - F.col("col1") - 1
    shade = (_pixels(core, "col1", "search_hi", "run_start", "run_end")
             .where((F.col("col") < F.col("search_hi")) & j.between(F.col("run_start"), F.col("run_end")))
             .groupBy("det_id").agg(F.percentile("v", F.lit(0.5)).alias("shade")))
    m = d.select("det_id", "altitude_m", "x_far_m", "ground_res", "col1").join(levels, "det_id", "left").join(runs, "det_id", "left").join(shade, "det_id", "left")
    bg, has = F.col("background"), F.col("run_end").isNotNull()
    ratio = F.col("box_median") / bg
    x_end = (F.col("col1") + F.col("run_end") + 1.5) * F.col("ground_res")
    analysis = F.struct(
        F.coalesce(ratio >= cfg["highlight_min_ratio"], F.lit(False)).alias("has_highlight"), has.alias("has_shadow"),
        ratio.alias("highlight_ratio"), F.when(has, F.col("shade") / bg).alias("shadow_ratio"),
        F.when(has, (F.col("run_end") + 1) * F.col("ground_res")).otherwise(0.0).alias("shadow_len_m"),
        F.when(has & (x_end > 0), F.col("altitude_m") * (x_end - F.col("x_far_m")) / x_end).alias("height_m"),
        bg.alias("background"), F.col("altitude_m").alias("altitude_m"), F.col("x_far_m").alias("x_far_m"), F.when(has, x_end).alias("x_end_m"))
    return dets.join(m.select("det_id", analysis.alias("analysis")), "det_id", "left")


# ---- features ----------------------------------------------------------------

def dark_run_end(row: Column, level: Column, lead_in: int = 4, tolerance: int = 2, min_run: int = 2) -> Column:
    """Last column of the dark run of one row, NULL without a run; no-data ends the run."""
    dark = lambda v: F.coalesce(v < level, F.lit(False))
    head = F.slice(row, 1, max(lead_in, 1))
    start = (F.array_position(F.transform(head, dark), F.lit(True)) - 1).cast("int")
    cell = lambda v, i: F.struct(v.alias("v"), i.alias("i"))
    zero = F.struct(start.alias("e"), F.lit(0).alias("m"), F.lit(False).alias("stop"))

    def step(s, c):
        on = (c["i"] > start) & ~s["stop"]
        miss = F.when(dark(c["v"]), F.lit(0)).otherwise(s["m"] + 1)
        return F.when(on, F.struct(F.when(dark(c["v"]), c["i"]).otherwise(s["e"]).alias("e"), miss.alias("m"),
                                   (c["v"].isNull() | (miss > tolerance)).alias("stop"))).otherwise(s)

    end = F.aggregate(F.transform(row, cell), zero, step)["e"]
    return F.when((start >= 0) & (end - start + 1 >= min_run), end)


def shadow_linearity(crop: DataFrame, levels: DataFrame, cfg: dict = K.SHADOW, min_rows: int = 4, floor_std: float = 3.0,
                     gate: float = 6.0, gate_min: float = 6.0) -> DataFrame:
    """Straightness of the shadow's far edge: outlier-gated line fit of per-ping run ends, 0..1."""
    rows = crop.join(levels, "det_id").where("background IS NOT NULL")
    window = F.slice("cols", F.col("col1") + 2 - F.col("lo_col"), F.greatest(F.col("search_hi") - F.col("col1") - 1, F.lit(0)))
    ends = rows.select("det_id", F.col("row").cast("double").alias("x"), dark_run_end(
        window, cfg["shadow_thresh"] * F.col("background"), cfg["lead_in"], cfg["tolerance"]).cast("double").alias("y")).where("y IS NOT NULL")
    med = ends.groupBy("det_id").agg(F.percentile("y", F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    dev = ends.join(med, "det_id").withColumn("d", F.abs(F.col("y") - F.col("med")))
    mad = dev.groupBy("det_id").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    kept = dev.join(mad, "det_id").where(F.col("d") <= F.greatest(gate * F.col("mad"), F.lit(gate_min)))
    fit = kept.groupBy("det_id").agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"),
                                     F.regr_syy("y", "x").alias("syy")).where(F.col("n") >= min_rows)
    res = F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return fit.select("det_id", clamp(1.0 - res / F.greatest("syy", F.col("n") * floor_std ** 2), 0.0, 1.0).alias("shadow_linearity"))


def contour_regularity(crop: DataFrame, levels: DataFrame, highlight: float = 1.5) -> DataFrame:
    """Fill of the bounding box of the largest bright blob inside the detection box."""
    rows = crop.join(levels, "det_id").where("background IS NOT NULL")
    box = F.slice("cols", F.col("col0") + 1 - F.col("lo_col"), F.col("col1") - F.col("col0") + 1)
    lit = rows.select("det_id", "row", F.transform(box, lambda v: v > highlight * F.col("background")).alias("flags"))
    runs = cut_lineage(row_runs(lit, ["det_id"], "flags", "row"))
    per = blobs(runs, ["det_id"], "row").groupBy("det_id", "blob").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("area"),
        ((F.max("row") - F.min("row") + 1) * (F.max("c1") - F.min("c0") + 1)).alias("bbox"))
    biggest = F.max_by(F.struct("area", "bbox"), F.struct("area", (-F.xxhash64("blob")).alias("o"))).alias("b")
    return per.groupBy("det_id").agg(biggest).select("det_id", (F.col("b.area") / F.col("b.bbox")).alias("contour_regularity"))


def texture_entropy_delta(dets: DataFrame, ground: DataFrame, ring: int = 8, n_bins: int = 16) -> DataFrame:
    """Entropy inside the (clipped) box minus entropy of the ring around it, over shared bin edges."""
    d = dets.select("det_id", *SIDE, *BOX, F.greatest(F.col("col0") - ring, F.lit(0)).alias("lo_col"),
                    F.least(F.col("col1") + ring, F.col("n_cols").cast("int") - 1).alias("hi_col"))
    crop = cut_lineage(crop_rows(d, ground, row_margin=ring))
    edges = crop.groupBy("det_id").agg(F.min(F.array_min("cols")).alias("lo"), F.max(F.array_max("cols")).alias("hi")).where("hi > lo")
    inner = F.col("row").between(F.col("ping0"), F.col("ping1")) & F.col("col").between(F.col("col0"), F.col("col1"))
    b = _pixels(crop.join(edges, "det_id"), *BOX, "lo", "hi").where("v IS NOT NULL").withColumn("inner", inner)      # rows move, not pixels
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))
    hist = b.groupBy("det_id", "inner", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy("det_id", "inner").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    ent = hist.join(total, ["det_id", "inner"]).groupBy("det_id").agg(
        F.sum(F.when(F.col("inner"), -p * F.log2(p)).otherwise(0.0)).alias("i"), F.sum(F.when(~F.col("inner"), -p * F.log2(p)).otherwise(0.0)).alias("o"))
    return ent.select("det_id", (F.col("i") - F.col("o")).alias("texture_entropy_delta"))


def features(dets: DataFrame, ground: DataFrame, altitude: DataFrame, grid: DataFrame, cfg: dict = K.SHADOW) -> DataFrame:
    """The thirteen verifier features per detection, in the fixed order; unmeasured ones are -1 (`has_height` tells)."""
    clipped, crop, measured = _measured(dets, ground, altitude, grid, cfg)
    levels = measured.select("det_id", "background")
    a = _analysed(dets, clipped, crop, measured, cfg).select("det_id", "analysis", "score")
    out = clipped.select("det_id", *BOX, "n_cols").join(a, "det_id")
    for part in (shadow_linearity(crop, levels, cfg), contour_regularity(crop, levels), texture_entropy_delta(clipped, ground)):
        out = out.join(part, "det_id", "left")
    h, w = F.col("ping1") - F.col("ping0") + 1, F.col("col1") - F.col("col0") + 1
    cue = lambda n: F.coalesce(F.col(f"analysis.{n}"), F.lit(-1.0))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    value = {
        **{n: cue(n) for n in ("highlight_ratio", "shadow_ratio", "shadow_len_m", "height_m")},
        "has_height": F.col("analysis.height_m").isNotNull().cast("double"),
        **{n: zero(F.col(n)) for n in ("shadow_linearity", "contour_regularity", "texture_entropy_delta")},
        "ping_persistence": h.cast("double"), "aspect_ratio": h.cast("double") / w, "area_px": (h * w).cast("double"),
        "range_frac": (F.col("col0") + F.col("col1")) / 2.0 / F.col("n_cols"), "score_raw": zero(F.col("score"))}
    return out.select("det_id", *[value[n].alias(n) for n in K.FEATURE_NAMES])


# ---- verification ------------------------------------------------------------

def verify(dets: DataFrame, ground: DataFrame, altitude: DataFrame, grid: DataFrame, verifier_p: DataFrame | None = None,
           scoring: dict = K.SCORING, cfg: dict = K.SHADOW) -> DataFrame:
    """Every detection with its analysis, gate, confidence, persistence and multipath flag; none is dropped.

    `verifier_p(det_id, verifier_p)` is optional: without it the confidence is the physics-only one.
    """
    d = analyse_shadows(dets, ground, altitude, grid, cfg)
    if verifier_p is not None:
        d = d.join(verifier_p, "det_id", "left")
    else:
        d = d.withColumn("verifier_p", F.lit(None).cast("double"))
    at = altitude.select("survey", F.col("ping").alias("ping0"), F.col("altitude_m").alias("_alt0"))
    d = salted_join(d.join(at, ["survey", "ping0"], "left"), grid.select(*SIDE, "ground_res"), SIDE, "det_id")
    gate = demote_thin(physics_gate("cls", "analysis.has_highlight", "analysis.has_shadow", "analysis.height_m", scoring), "ping0", "ping1", scoring)
    ground_m = (0.5 * (F.col("col0") + F.col("col1")) + 0.5) * F.col("ground_res")
    d = d.withColumn("_g", gate)
    mult = F.col("_g.multiplier") * verifier_factor("verifier_p", scoring)
    return d.withColumns({
        "gate": F.struct(mult.alias("multiplier"), F.col("_g.violation").alias("violation"), F.col("_g.reason").alias("reason")),
        "persistence_pings": F.col("ping1") - F.col("ping0") + 1, "multipath_suspect": is_multipath_candidate(ground_m, "_alt0"),
    }).withColumn("confidence_pct", confidence_pct("score", "gate.multiplier", scoring["temperature"])).drop("_g", "_alt0", "ground_res")


# ---- classical detector ------------------------------------------------------

def column_background(ground: DataFrame) -> DataFrame:
    """Median and robust sigma per ground column; a dead column borrows the survey-side's median sigma."""
    px = ground.select(*SIDE, F.posexplode("cols").alias("col", "v")).where("v IS NOT NULL")
    rows = int(ground.groupBy(*SIDE).count().agg(F.max("count")).first()[0] or 0)
    med = cut_lineage(exact_percentiles(px, [*SIDE, "col"], "v", {"med": 0.5}, group_rows=rows))
    arrays = med.groupBy(*SIDE).agg(F.map_from_entries(F.collect_list(F.struct("col", "med"))).alias("_m"))   # one entry per column
    dev = (salted_join(ground, arrays, SIDE, "ping")
           .select(*SIDE, F.posexplode(F.transform("cols", lambda v, i: F.abs(v - F.col("_m")[i]))).alias("col", "d")).where("d IS NOT NULL"))
    mad = exact_percentiles(dev, [*SIDE, "col"], "d", {"mad": 0.5}, group_rows=rows)
    b = cut_lineage(med.join(mad, [*SIDE, "col"]).withColumn("sigma", 1.4826 * F.col("mad")))
    spare = exact_percentiles(b.where("sigma > 0"), SIDE, "sigma", {"_spare": 0.5})
    return b.join(spare, SIDE, "left").select(
        *SIDE, "col", "med", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.coalesce("_spare", F.lit(0.001))).alias("sigma"))


def background_arrays(background: DataFrame, grid: DataFrame) -> DataFrame:
    """The column table as one array pair per survey-side (dead columns: 0 and the borrowed sigma)."""
    m = background.groupBy(*SIDE).agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("med", "sigma")))).alias("_m"),
                                      F.percentile("sigma", F.lit(0.5)).alias("_s"))
    g = grid.select(*SIDE, "n_cols").join(m, SIDE)
    idx = F.sequence(F.lit(0), F.col("n_cols") - 1)
    return g.select(*SIDE, F.transform(idx, lambda i: F.coalesce(F.col("_m")[i]["med"], F.lit(0.0))).alias("med"),
                    F.transform(idx, lambda i: F.coalesce(F.col("_m")[i]["sigma"], F.col("_s"))).alias("sigma"))


def classical_blobs(ground: DataFrame, grid: DataFrame, k_sigma: float = 3.0, open_radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(blob runs with pixel sums, column arrays): pixels above med + k sigma, opened, connected."""
    arrays = cut_lineage(background_arrays(column_background(ground), grid))
    rows = salted_join(ground, arrays, SIDE, "ping")
    hot = rows.select(*SIDE, "ping", F.transform("cols", lambda v, i: v > F.get("med", i) + k_sigma * F.get("sigma", i)).alias("mask"))
    opened = open_mask(hot, grid, open_radius)
    runs = cut_lineage(row_runs(opened, SIDE, "mask"))
    vals = runs.join(ground, [*SIDE, "ping"])
    part = F.slice("cols", F.col("c0") + 1, F.col("c1") - F.col("c0") + 1)
    vals = vals.select(*SIDE, "ping", "c0", "c1", "run_id", F.aggregate(part, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"),
                       F.size(F.filter(part, lambda v: v.isNotNull())).alias("n"), F.array_max(part).alias("peak"))
    return blobs(cut_lineage(vals), SIDE), arrays


def blob_table(runs: DataFrame) -> DataFrame:
    """Extent, area, mean and peak per blob."""
    return runs.groupBy(*SIDE, "blob").agg(
        F.min("ping").alias("ping0"), F.max("ping").alias("ping1"), F.min("c0").alias("col0"), F.max("c1").alias("col1"),
        F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.max("peak").alias("peak"))


def shadow_fraction(boxes: DataFrame, ground: DataFrame, arrays: DataFrame, search: int = 48, darkness: float = 0.7) -> DataFrame:
    """Dark share of the strip behind each box against the column background; 0 when the strip is off the swath."""
    d = boxes.withColumns({"lo_col": F.col("col1") + 1, "hi_col": F.col("col1") + search})
    crop = crop_rows(d.select(*SIDE, "det_id", *BOX, "lo_col", "hi_col"), ground)
    j = salted_join(crop, arrays.select(*SIDE, "med"), SIDE, "det_id")
    lo = F.col("lo_col")
    dark = F.size(F.filter(F.transform("cols", lambda v, i: v < darkness * F.get("med", lo + i)), lambda x: x))
    n = F.size(F.filter("cols", lambda v: v.isNotNull()))
    frac = j.groupBy("det_id").agg(F.coalesce(F.try_divide(F.sum(dark).cast("double"), F.sum(n)), F.lit(0.0)).alias("shadow_frac"))
    return boxes.join(frac, "det_id", "left").withColumn("shadow_frac", F.coalesce("shadow_frac", F.lit(0.0)))


def classical_detect(ground: DataFrame, grid: DataFrame, k_sigma: float = 3.0, min_area: int = 12, max_area: int = 100_000,
                     open_radius: int = 1, max_aspect: float = 12.0, require_shadow: bool = False, min_shadow: float = 0.35,
                     pad_cols: int = 3) -> DataFrame:
    """Blob detector over all survey-sides: boxes padded down-range, scored by signal over spread."""
    runs, arrays = classical_blobs(ground, grid, k_sigma, open_radius)
    b = blob_table(runs).where(blob_filter(min_area, max_area, max_aspect)).withColumnRenamed("blob", "det_id")
    if require_shadow:
        b = shadow_fraction(cut_lineage(b), ground, arrays).where(F.col("shadow_frac") >= min_shadow)
    j = salted_join(b, arrays.join(grid.select(*SIDE, "n_cols"), SIDE), SIDE, "det_id")
    width = F.col("col1") - F.col("col0") + 1
    avg = lambda c: F.aggregate(F.slice(c, F.col("col0") + 1, width), F.lit(0.0), lambda a, v: a + v) / width
    return j.where("mean IS NOT NULL").select(
        "det_id", *SIDE, "ping0", "ping1", "col0", F.least(F.col("col1") + pad_cols, F.col("n_cols").cast("int") - 1).alias("col1"),
        F.lit("unclassified").alias("cls"), snr_score("mean", avg("med"), avg("sigma")).alias("score"), F.lit("classical").alias("brain"), "area", "peak")
