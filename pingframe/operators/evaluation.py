"""Matching, metrics, calibration and corpus reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.boxes import BOX
from ..functions.scoring import calibration_bin, default_grid, logit, nll_term
from ..session import cut_lineage, written
from .joins import box_pairs, place_pairs
from .matching import Candidates, match_in_groups
from .scale import running_sums


# ---- matching ----------------------------------------------------------------

def match_candidates(scored: DataFrame, truth: DataFrame, min_iou: float = 0.3, any_class: bool = False,
                     keys: Sequence[str] = ("survey", "side"), listed: bool = True) -> DataFrame | Candidates:
    """(det_id, truth_id, iou) pairs at or above the threshold; equal boxes are met once.

    Without `listed` many detections are left to the matching, which meets them where it needs them.
    """
    on = [*keys] if any_class else [*keys, "cls"]
    if not listed and (pairs := Candidates(scored, truth, min_iou, on)).fit_into_tasks():
        return pairs
    return place_pairs(scored, truth, on, min_iou, "det_id", "truth_id").select(
        F.col("l_id").alias("det_id"), F.col("r_id").alias("truth_id"), "iou")


def any_match(scored: DataFrame, truth: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """`correct`: some truth of the same class and side overlaps enough (not exclusive); equal boxes are met once."""
    keys = ["survey", "side", "cls"]
    place = [*keys, *BOX]
    pairs = box_pairs(scored.select(*place).distinct(), truth.select(*place).distinct(), keys, min_iou)
    met = pairs.select(*[F.col(f"l_{c}").alias(c) for c in place]).distinct()
    hit = scored.select("det_id", *place).join(met, place, "left_semi").select("det_id").distinct().withColumn("_hit", F.lit(True))
    return scored.join(hit, "det_id", "left").withColumn("correct", F.coalesce("_hit", F.lit(False))).drop("_hit")


def match_greedy(scored: DataFrame, candidates: DataFrame | Candidates, keys: Sequence[str] = ("config",),
                 confidence: str = "confidence") -> DataFrame:
    """One-to-one matching in confidence order: each detection claims its best free truth.

    Adds `truth_id` and `is_tp`.  Rounds: every open detection proposes its best
    free truth, every truth goes to its most confident proposer unless a more
    confident open detection could still want it; the result is the sequential one.
    Candidates that are not listed are met in the tasks that hold a group; `scored` then has the boxes of their detections.
    """
    keys = list(keys)
    if isinstance(candidates, Candidates):
        return match_in_groups(scored, candidates, keys, confidence).withColumn("is_tp", F.col("truth_id").isNotNull())
    prio = F.struct((-F.col(confidence)).alias("c"), F.col("det_id").alias("i"))
    pref = F.struct((-F.col("iou")).alias("v"), F.col("truth_id").alias("t"))
    # rounds are written as plain columns: an id lies once in a row, and files are columnar and compressed
    open_ = written(scored.select(*keys, "det_id", confidence).join(candidates.select("det_id", "truth_id", "iou"), "det_id"))
    taken = None
    while not open_.isEmpty():
        edges = open_.select(*keys, "det_id", "truth_id", prio.alias("p"), pref.alias("q"))
        # a detection first in line at every truth it may want takes its best one
        first = edges.groupBy(*keys, "truth_id").agg(F.min("p").alias("first"))
        lined = edges.join(first, [*keys, "truth_id"])
        ready = (lined.groupBy(*keys, "det_id").agg(
            F.min(F.struct("q", "truth_id", "p", "first")).alias("b"))
            .where(F.col("b.p") == F.col("b.first"))
            .select(*keys, "det_id", F.col("b.truth_id").alias("truth_id")))
        ready = cut_lineage(ready)
        taken = ready if taken is None else taken.unionByName(ready)
        open_ = written(open_.join(ready.select(*keys, "det_id"), [*keys, "det_id"], "left_anti")
                        .join(ready.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti"))
    if taken is None:
        return scored.withColumns({"truth_id": F.lit(None).cast("string"), "is_tp": F.lit(False)})
    return (scored.join(taken, [*keys, "det_id"], "left")
            .withColumn("is_tp", F.col("truth_id").isNotNull()))


def ablation(dets: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """The same detections once per configuration with that configuration's confidence."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), expr.alias("confidence")) for name, expr in configs.items()]))
    return dets.select("*", rows.alias("_c")).select(*dets.columns, "_c.config", "_c.confidence")


# ---- metrics -----------------------------------------------------------------

def point_metrics(labels: DataFrame, truth_counts: DataFrame, floor: float | Column = 50.0,
                  keys: Sequence[str] = ("config",)) -> DataFrame:
    """TP, FP, precision, recall, F1 and FP per km2 at a confidence floor.

    `truth_counts(keys..., n_truth, area_km2)`; empty denominators give 0, an unknown area NULL.
    """
    keys = list(keys)
    sel = F.col("confidence") >= floor
    agg = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_detections"), F.count_if(sel & F.col("is_tp")).alias("tp"),
        F.count_if(sel & ~F.col("is_tp")).alias("fp"))
    d = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    out = agg.join(truth_counts, keys, "left")
    out = out.withColumns({"precision": d("tp", F.col("tp") + F.col("fp")), "recall": d("tp", F.col("n_truth"))})
    f1 = F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    area = F.when(F.col("area_km2") > 0, F.col("area_km2"))
    return out.withColumns({"f1": f1, "fp_per_km2": F.try_divide(F.col("fp").cast("double"), area)})


def pr_auc(labels: DataFrame, truth_counts: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Average precision over the confidence ranking (ties by det_id)."""
    keys = list(keys)
    ranked_rows = running_sums(labels.withColumns({"_one": F.lit(1), "_t": F.col("is_tp").cast("int")}), keys,
                               [F.desc("confidence"), F.asc("det_id")], {"_k": "_one", "_cum": "_t"})
    gain = ranked_rows.groupBy(*keys).agg(F.sum(F.when(F.col("is_tp"), F.col("_cum") / F.col("_k")).otherwise(0.0)).alias("_s"))
    return (gain.join(truth_counts, keys, "left")
            .withColumn("pr_auc", F.coalesce(F.try_divide(F.col("_s"), F.col("n_truth")), F.lit(0.0))).select(*keys, "pr_auc"))


def best_floor(labels: DataFrame, truth_counts: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Distinct-confidence cut with the best F1 (highest confidence on ties), and that F1."""
    keys = list(keys)
    per = labels.groupBy(*keys, "confidence").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_tp").alias("_t"))
    cum = running_sums(per, keys, [F.desc("confidence")], {"kept": "_n", "tp": "_t"}).join(truth_counts, keys)
    prec, rec = F.col("tp") / F.col("kept"), F.try_divide(F.col("tp").cast("double"), F.col("n_truth"))
    f1 = F.coalesce(F.try_divide(2.0 * prec * rec, prec + rec), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), F.col("confidence"))).alias("b")
    return cum.groupBy(*keys).agg(best).select(*keys, F.col("b.f1").alias("best_f1"), F.col("b.confidence").alias("floor"))


def select_setting(curve: DataFrame, tol: float = 0.02) -> DataFrame:
    """Best k per variant from (variant, k, f1, cut), with a note when it sits on the end of the grid."""
    ends = curve.groupBy("variant").agg(F.min("k").alias("k_lo"), F.max("k").alias("k_hi"), F.count(F.lit(1)).alias("n_grid"))
    c = curve.join(ends, "variant")
    inner = (F.col("k") != F.col("k_lo")) & (F.col("k") != F.col("k_hi"))
    best = F.max(F.struct(F.col("f1"), (-F.col("k")).alias("o"), F.col("cut"))).alias("b")   # the first k wins ties
    out = c.groupBy("variant", "k_lo", "k_hi", "n_grid").agg(
        best, F.max(F.when(inner, F.col("f1"))).alias("interior"), F.max(F.when(~inner, F.col("f1"))).alias("endpoint"))
    k = -F.col("b.o")
    at_end = (k == F.col("k_lo")) | (k == F.col("k_hi"))
    note = (F.when(~at_end, F.lit(None).cast("string")).when(F.col("interior").isNull(), F.lit("no interior"))
            .when(F.col("endpoint") - F.col("interior") <= tol, F.lit("plateau")).otherwise(F.lit("widen the grid")))
    return out.select("variant", k.alias("k"), F.col("b.f1").alias("f1"), F.col("b.cut").alias("cut"), note.alias("note"))


def at_clutter_levels(rows: DataFrame, levels: Sequence[int], rank: str = "decoy_rank") -> DataFrame:
    """Rows once per clutter level that contains them (level L holds decoys ranked 1..L; rank 0 is always there)."""
    return rows.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).where(F.col(rank) <= F.col("level"))


# ---- calibration -------------------------------------------------------------

def reliability(scored: DataFrame, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Bin centre, accuracy, mean score and count per filled calibration bin."""
    b = scored.withColumn("bin", calibration_bin("score", n_bins)).where("bin IS NOT NULL")
    return b.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("score").alias("mean_score")).withColumn("centre", (F.col("bin") + 0.5) / n_bins)


def expected_calibration_error(scored: DataFrame, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted gap between accuracy and score; rows outside every bin still count in the weights."""
    b = scored.withColumn("bin", calibration_bin("score", n_bins))
    per = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"),
                                      F.avg("score").alias("conf"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def nll_by_temperature(scored: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """Mean negative log-likelihood at every temperature, in one pass and one row per temperature."""
    base = scored.select(logit("score").alias("_z"), F.col("correct").cast("double").alias("_c"))
    sums = base.agg(*[F.avg(nll_term("_z", "_c", t)).alias(f"t{i}") for i, t in enumerate(temperatures)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])
    return sums.select(F.inline(rows))


def fit_temperature(scored: DataFrame, lo: float = 0.05, hi: float = 20.0, grid: int = 25, passes: int = 4) -> float:
    """Temperature of least NLL in [lo, hi]: a grid, then finer grids around the best point.

    Each pass is one distributed aggregate over (score, correct) counts.
    """
    pairs = cut_lineage(scored.groupBy("score", F.col("correct").cast("double").alias("correct"))
                        .agg(F.count(F.lit(1)).alias("w")))
    best = None
    for _ in range(passes):
        ts = default_grid(lo, hi, grid)
        z = pairs.select(logit("score").alias("_z"), F.col("correct").alias("_c"), "w")
        row = z.agg(*[F.sum(nll_term("_z", "_c", t) * F.col("w")).alias(f"t{i}") for i, t in enumerate(ts)]).first()
        i = min(range(grid), key=lambda k: row[k])
        best, lo, hi = ts[i], ts[max(i - 1, 0)], ts[min(i + 1, grid - 1)]
    return best


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC on distinct scores (ties count half)."""
    keys = list(keys)
    per = scored.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"),
                                           F.count_if(F.col(label) == 0).cast("double").alias("n"))
    cum = running_sums(per, keys, [F.asc(score)], {"cn": "n"})
    part = F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2))
    return cum.groupBy(*keys).agg(F.try_divide(part, F.sum("p") * F.sum("n")).alias("auc"))


def accuracy(scored: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    ok = (F.col(score) >= threshold).cast("int") == F.col(label)
    return scored.groupBy(*keys).agg(F.avg(ok.cast("double")).alias("accuracy"))


# ---- corpus reports ----------------------------------------------------------

def image_behaviour(dets: DataFrame, floor: float = 50.0) -> DataFrame:
    """Per image: raw detections, split by brain, above the floor, strongest class."""
    return dets.groupBy("image").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("cls") != K.ANOMALY_CLASS).alias("n_brain_a"),
        F.count_if(F.col("cls") == K.ANOMALY_CLASS).alias("n_anomaly"),
        F.count_if(F.col("confidence") >= floor).alias("n_above_floor"),
        F.max(F.struct("score", "cls")).alias("_top"),
        F.max(F.col("cls").isin(*K.WRECK_LIKE)).alias("reaches_wreck")).select(
        "*", F.col("_top.cls").alias("top_class"), F.col("_top.score").alias("top_score")).drop("_top")


def corpus_report(per_image: DataFrame, images: DataFrame) -> DataFrame:
    """Totals over a corpus; images without detections count."""
    a = images.select("image", "kind").join(per_image, "image", "left").na.fill(0, ["n_raw", "n_brain_a", "n_anomaly", "n_above_floor"])
    n = F.count(F.lit(1))
    return a.agg(
        n.alias("images"), F.sum("n_raw").alias("raw"), (F.sum("n_raw") / n).alias("raw_per_image"),
        F.try_divide(100.0 * F.sum("n_brain_a"), F.sum("n_raw")).alias("brain_a_pct"),
        F.sum("n_above_floor").alias("above_floor"), F.avg(F.when(F.col("top_score") > 0, F.col("top_score"))).alias("mean_top_score"),
        F.count_if((F.col("kind") == "ship") & F.coalesce("reaches_wreck", F.lit(False))).alias("ships_reaching"))


def class_reach(preds: DataFrame, classes: Sequence[str] = tuple(K.WRECK_LIKE), keys: Sequence[str] = ()) -> DataFrame:
    """Share of images whose most confident prediction is one of `classes`."""
    top = preds.groupBy(*keys, "image").agg(F.max(F.struct("confidence", "cls")).alias("t"))
    hit = F.coalesce(F.col("t.cls").isin(*classes), F.lit(False))
    return top.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"),
                                  F.avg(hit.cast("double")).alias("reach"))


def acceptance_gates(metrics: DataFrame, reach: DataFrame, tolerance: float = 0.03, reference_set: str = "synth") -> DataFrame:
    """One verdict row from metrics(val_set, model, map50) and reach(model, reach), models baseline/candidate."""
    m = metrics.where(F.col("val_set") == reference_set).agg(
        F.max(F.when(F.col("model") == "baseline", F.col("map50"))).alias("b"),
        F.max(F.when(F.col("model") == "candidate", F.col("map50"))).alias("c"))
    r = reach.agg(F.max(F.when(F.col("model") == "baseline", F.col("reach"))).alias("rb"),
                  F.max(F.when(F.col("model") == "candidate", F.col("reach"))).alias("rc"))
    both = m.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k").drop("_k")     # two one-row tables
    return both.select(
        (F.col("b") - F.col("c")).alias("drop"), F.when(F.col("b") - F.col("c") <= tolerance, "PASS").otherwise("FAIL").alias("gate_regression"),
        F.col("rb").alias("reach_baseline"), F.col("rc").alias("reach_candidate"),
        F.when(F.col("rc") > F.col("rb"), "PASS").otherwise("FAIL").alias("gate_reach"))


def composition(rows: DataFrame, source: str = "source", split: str = "split") -> DataFrame:
    """Rows per source and split with the source's share of its split."""
    per = rows.groupBy(source, split).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(split).agg(F.sum("n").alias("_t"))
    return per.join(total, split).withColumn("share_pct", 100.0 * F.col("n") / F.col("_t")).drop("_t")


def error_fractions(errors: DataFrame, q: float = 0.995, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """Error quantile per corpus and the share of its pixels above it."""
    from .scale import exact_percentiles
    cut = exact_percentiles(errors, list(keys), "v", {"threshold": q})
    joined = errors.join(cut, list(keys))
    return joined.groupBy(*keys).agg(F.first("threshold").alias("threshold"),
                                     F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("share_above"))


def taxonomy_mismatches(source_classes: DataFrame) -> DataFrame:
    """Rows of (source, class_id, cls) that differ from the fixed class list, and ids a source lacks."""
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(c).alias("expected")) for i, c in enumerate(K.CLASS_NAMES)]))
    frame = source_classes.select("source").distinct().select("source", want.alias("w")).select("source", "w.*")
    both = frame.join(source_classes, ["source", "class_id"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("cls")))
