"""Interval, box and radius joins as bucketed equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import BOX, box_iou, box_of
from ..functions.geodesy import EARTH_M_PER_DEG_LAT, arc_from_chord, ecef
from ..session import cut_lineage
from .scale import salted_join

PLACE_IDS = 1000             # ids of equal boxes in a row; more go to several rows


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str,
               bucket: int = 256, how: str = "inner") -> DataFrame:
    """Rows of `points` whose `at` lies in [lo, hi] of `ranges`, by equi join on buckets of `at`."""
    left = points.withColumn("_bkt", F.floor(F.col(at) / bucket))
    right = ranges.withColumn("_bkt", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    on = [left[k] == right[k] for k in [*keys, "_bkt"]] + [left[at].between(right[lo], right[hi])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = left.join(right, cond, how)
    for k in [*keys, "_bkt"]:
        joined = joined.drop(right[k])
    return joined.drop("_bkt")


def _bucketed(df: DataFrame, p: str, size: int) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(f"{p}{a}") / size), F.floor(F.col(f"{p}{b}") / size))
    return (df.withColumn("_bp", F.explode(span("ping0", "ping1")))
            .withColumn("_bc", F.explode(span("col0", "col1"))))


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float | None = None,
              bucket: int = 64, extra: Column | None = None, lp: str = "l_", rp: str = "r_", large_left: bool = False) -> DataFrame:
    """Pairs of overlapping boxes (columns prefixed), one row per pair, with `iou`.

    Boxes meet in every grid bucket they both cover; the pair is emitted only in
    the bucket of the intersection's far corner, so no distinct is needed.  From
    an overlap of 0.5, or with many more boxes on the left, each left box is sent
    once, to the cell of its centre.
    """
    a = left.select(*[F.col(c).alias(f"{lp}{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{rp}{c}") for c in right.columns])
    ka, kb = box_of(lp), box_of(rp)
    if min_iou == 1.0:
        cond = extra if extra is not None else F.lit(True)
        for k in [*keys, *BOX]:
            cond = cond & (a[f"{lp}{k}"] == b[f"{rp}{k}"])
        return a.join(b, cond).withColumn("iou", box_iou(ka, kb)).where(F.col("iou") >= min_iou)
    if min_iou is not None and (min_iou >= 0.5 or large_left and min_iou > 0.0):
        return _centre_pairs(a, b, keys, min_iou, bucket // 2, extra, lp, rp)
    a, b = _bucketed(a, lp, bucket), _bucketed(b, rp, bucket)
    cond = (a["_bp"] == b["_bp"]) & (a["_bc"] == b["_bc"])
    for k in keys:
        cond = cond & (a[f"{lp}{k}"] == b[f"{rp}{k}"])
    overlap = ((ka["ping0"] <= kb["ping1"]) & (kb["ping0"] <= ka["ping1"])
               & (ka["col0"] <= kb["col1"]) & (kb["col0"] <= ka["col1"]))
    owner = ((F.floor(F.greatest(ka["ping0"], kb["ping0"]) / bucket) == a["_bp"])
             & (F.floor(F.greatest(ka["col0"], kb["col0"]) / bucket) == a["_bc"]))
    cond = cond & overlap & owner
    if extra is not None:
        cond = cond & extra
    out = a.join(b, cond).drop("_bp", "_bc").withColumn("iou", box_iou(ka, kb))
    return out.where(F.col("iou") >= min_iou) if min_iou is not None else out


def folded(df: DataFrame, place: Sequence[str], ident: str, distinct: bool = False, chunk: int | None = None) -> DataFrame:
    """One row per place with its ids, once each if `distinct` (`_ids`, array of struct(id)); a place with more than `chunk` rows has several, numbered `_chunk`."""
    rows = df.select(*place, F.struct(F.col(ident).alias("id")).alias("_id"), F.xxhash64(*place).alias("_h"))
    chunk = PLACE_IDS if chunk is None else chunk
    big = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    big = cut_lineage(big.select("_h", F.ceil(F.col("_n") / chunk).cast("int").alias("_parts")))
    if big.isEmpty():
        rows = rows.withColumn("_chunk", F.lit(0))
    else:                                        # the same id is always in the same part
        rows = (salted_join(rows, big, ["_h"], "_id", how="left")
                .withColumn("_chunk", F.pmod(F.xxhash64("_id.id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts"))
    return rows.groupBy("_h", *place, "_chunk").agg((F.collect_set if distinct else F.collect_list)("_id").alias("_ids")).drop("_h")


def place_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float, left_id: str, right_id: str) -> DataFrame:
    """(l_id, r_id, iou) of overlapping boxes, a left id once per box: equal boxes meet once, and their ids are paired where they met."""
    place = [*keys, *BOX]
    p = box_pairs(folded(left, place, left_id, True), folded(right, place, right_id), keys, min_iou)
    one = p.select("iou", F.explode("l__ids").alias("x"), "r__ids")
    return one.select("x", F.explode("r__ids").alias("y"), "iou").select(F.col("x.id").alias("l_id"), F.col("y.id").alias("r_id"), "iou")


def own_place_pairs(df: DataFrame, keys: Sequence[str], min_iou: float, ident: str) -> DataFrame:
    """(l_id, r_id, iou) with l_id < r_id of the overlapping boxes of one table; equal boxes meet once."""
    f = folded(df, [*keys, *BOX], ident)
    at = lambda p: F.struct(*[F.col(f"{p}{c}") for c in ("ping0", "col0", "ping1", "col1", "_chunk")])
    p = box_pairs(f, f, keys, min_iou, extra=at("l_") <= at("r_"))
    one = p.select("iou", (at("l_") == at("r_")).alias("same"), F.explode("l__ids").alias("x"), "r__ids")
    two = one.select("iou", "same", "x", F.explode("r__ids").alias("y")).where((F.col("x.id") < F.col("y.id")) | (~F.col("same") & (F.col("x.id") > F.col("y.id"))))
    return two.select(F.least("x.id", "y.id").alias("l_id"), F.greatest("x.id", "y.id").alias("r_id"), "iou")


def _centre_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], min_iou: float, cell: int, extra: Column | None, lp: str, rp: str) -> DataFrame:
    """Pairs that overlap at `min_iou`: every left box in the cell of its centre, every right box in those where such a centre can be.

    On each axis the intervals overlap at `min_iou` too, so the centres lie within
    (1 / min_iou - 1) / 2 lengths of the right box of each other.
    """
    reach = (1.0 / min_iou - 1.0) / 2.0
    axes = (("_bp", "ping0", "ping1"), ("_bc", "col0", "col1"))
    centre = lambda p, lo, hi: (F.col(f"{p}{lo}").cast("double") + F.col(f"{p}{hi}")) / 2.0
    for name, lo, hi in axes:
        a = a.withColumn(name, F.floor(centre(lp, lo, hi) / cell))
        far = F.greatest(F.col(f"{rp}{hi}").cast("double") - F.col(f"{rp}{lo}") + 1.0, F.lit(0.0)) * reach + 1e-6
        b = b.withColumn(name, F.explode(F.sequence(F.floor((centre(rp, lo, hi) - far) / cell), F.floor((centre(rp, lo, hi) + far) / cell))))
    # two hashes stand for cell and keys: short rows, and sorting compares numbers
    names = lambda p: [F.col(f"{p}{k}") for k in keys]
    there = lambda p: F.coalesce(*[F.when(c.isNull(), F.lit(False)) for c in names(p)], F.lit(True))
    hashes = lambda p: {"_h": F.xxhash64("_bp", "_bc", *names(p)), "_g": F.xxhash64(F.lit("g"), "_bp", "_bc", *names(p))}
    a, b = a.where(there(lp)).withColumns(hashes(lp)), b.where(there(rp)).withColumns(hashes(rp))
    cond = (a["_h"] == b["_h"]) & (a["_g"] == b["_g"])
    ka, kb = box_of(lp), box_of(rp)
    cond = (cond & (ka["ping0"] <= kb["ping1"]) & (kb["ping0"] <= ka["ping1"]) & (ka["col0"] <= kb["col1"]) & (kb["col0"] <= ka["col1"])
            & (box_iou(ka, kb) >= min_iou))
    if extra is not None:
        cond = cond & extra
    return a.join(b, cond).drop("_bp", "_bc", "_h", "_g").withColumn("iou", box_iou(ka, kb))


# ---- positions ---------------------------------------------------------------

def with_cells(df: DataFrame, metres: float, lat: str = "lat", lon: str = "lon", prefix: str = "_") -> DataFrame:
    """Grid cell at least `metres` wide both ways.

    Longitude cells are sized for the latitude band they lie in (bands of one
    degree), so the cell is never narrower than `metres`.
    """
    band = F.floor(F.col(lat))
    lon_step = metres / (EARTH_M_PER_DEG_LAT * 0.99) / F.greatest(
        F.least(F.cos(F.radians(band)), F.cos(F.radians(band + 1.0))), F.lit(0.01))
    lat_step = metres / (EARTH_M_PER_DEG_LAT * 0.99)
    return df.withColumns({
        f"{prefix}band": band.cast("int"),
        f"{prefix}cy": F.floor(F.col(lat) / lat_step),
        f"{prefix}cx": F.floor(F.col(lon) / lon_step)})


def _neighbour_cells(df: DataFrame, metres: float, lat: str, lon: str) -> DataFrame:
    """Each row once per grid cell that may hold a point within `metres` of it."""
    dlat = metres / (EARTH_M_PER_DEG_LAT * 0.99)
    bands = F.array_distinct(F.array(*[F.floor(F.col(lat) + d).cast("int") for d in (-dlat, 0.0, dlat)]))
    out = df.withColumn("_band", F.explode(bands))
    step = metres / (EARTH_M_PER_DEG_LAT * 0.99) / F.greatest(
        F.least(F.cos(F.radians(F.col("_band"))), F.cos(F.radians(F.col("_band") + 1.0))), F.lit(0.01))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (out.withColumn("_cy", F.explode(F.transform(near, lambda d: F.floor(F.col(lat) / dlat) + d)))
            .withColumn("_cx", F.explode(F.transform(near, lambda d: F.floor(F.col(lon) / step) + d))))


def radius_pairs(left: DataFrame, right: DataFrame, metres: float, keys: Sequence[str] = (),
                 lp: str = "l_", rp: str = "r_", extra=None, salts: int = 1) -> DataFrame:
    """Pairs of positions within `metres` with `distance_m`, by a 3x3-cell equi join.

    `salts` > 1 splits the right side of every cell so that one crowded cell is
    shared by several tasks.
    """
    def prepared(df, p):
        x, y, z = ecef("lat", "lon")
        df = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns],
                       x.alias(f"{p}x"), y.alias(f"{p}y"), z.alias(f"{p}z"))
        return df

    a = _neighbour_cells(prepared(left, lp), metres, f"{lp}lat", f"{lp}lon")
    b = with_cells(prepared(right, rp), metres, f"{rp}lat", f"{rp}lon")
    cond = (a["_band"] == b["_band"]) & (a["_cy"] == b["_cy"]) & (a["_cx"] == b["_cx"])
    if salts > 1:
        a = a.withColumn("_sl", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        b = b.withColumn("_sl", F.pmod(F.xxhash64(*[F.col(f"{rp}{c}") for c in right.columns]), F.lit(salts)).cast("int"))
        cond = (a["_band"] == b["_band"]) & (a["_cy"] == b["_cy"]) & (a["_cx"] == b["_cx"]) & (a["_sl"] == b["_sl"])
    for k in keys:
        cond = cond & (a[f"{lp}{k}"] == b[f"{rp}{k}"])
    if extra is not None:
        cond = cond & extra
    dist = arc_from_chord(*[F.col(f"{lp}{c}") - F.col(f"{rp}{c}") for c in "xyz"])
    out = a.join(b, cond).withColumn("distance_m", dist).where(F.col("distance_m") <= metres)
    return out.drop("_band", "_cy", "_cx", "_sl", *[f"{p}{c}" for p in (lp, rp) for c in "xyz"])


def crowding(left: DataFrame, right: DataFrame, metres: float, keys: Sequence[str] = ()) -> tuple[int, int]:
    """(candidate pairs, rows) the cell join would look at: the size check before choosing it."""
    a = (_neighbour_cells(left, metres, "lat", "lon").groupBy(*keys, "_band", "_cy", "_cx")
         .agg(F.count(F.lit(1)).alias("na")))
    b = with_cells(right, metres).groupBy(*keys, "_band", "_cy", "_cx").agg(F.count(F.lit(1)).alias("nb"))
    row = (a.join(b, [*keys, "_band", "_cy", "_cx"])
           .agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("pairs"),
                F.sum("na").alias("rows")).first())
    return int(row["pairs"] or 0), int(row["rows"] or 0)


def nearest_within(left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str,
                   keys: Sequence[str] = (), pair_budget: float = 64.0, min_budget: int = 20_000_000) -> DataFrame:
    """Nearest right row of every left row within `metres` (ties: smallest right id).

    Returns left_id, right_id, distance_m for matched rows.  When the cell join
    would look at too many pairs per row, the search walks down a pyramid of
    ever smaller cells instead, keeping only cells that can hold the nearest.
    """
    pairs, rows = crowding(left, right, metres, keys)
    if pairs <= max(pair_budget * rows, min_budget):
        a = left.select(*keys, left_id, "lat", "lon")
        b = right.select(*keys, right_id, "lat", "lon")
        cand = radius_pairs(a, b, metres, keys)
        best = F.min(F.struct(F.col("distance_m"), F.col(f"r_{right_id}"))).alias("m")
        return (cand.groupBy(f"l_{left_id}").agg(best)
                .select(F.col(f"l_{left_id}").alias(left_id), F.col(f"m.r_{right_id}").alias(f"near_{right_id}"),
                        F.col("m.distance_m").alias("distance_m")))
    return pyramid_nearest(left, right, metres, left_id, right_id, keys)


def pyramid_nearest(left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str,
                    keys: Sequence[str] = (), finest_m: float = 0.1) -> DataFrame:
    """`nearest_within` for crowded places: linear work however many points share a cell.

    Copies (same key and position) are folded first.  Right positions are
    summarised per cell (bounding box in earth-centred coordinates) on halving
    cell sizes.  Per left position the frontier keeps cells whose lower distance
    bound does not exceed the best upper bound found so far, then opens them.
    """
    keys = list(keys)
    pos = [*keys, "lat", "lon"]
    lpos = (left.groupBy(*pos).agg(F.min(left_id).alias("_lid"), F.count(F.lit(1)).alias("_n")))
    rpos = right.groupBy(*pos).agg(F.min(right_id).alias("_rid"))
    x, y, z = ecef("lat", "lon")
    lpos = lpos.withColumns({"_x": x, "_y": y, "_z": z})
    rpos = rpos.withColumns({"_x": x, "_y": y, "_z": z})
    levels = 1
    while metres / 2 ** levels > finest_m:
        levels += 1
    cells = with_cells(rpos, metres)
    # nested cells: the child index is the parent's cell plus quadrant bits
    lat_step = metres / (EARTH_M_PER_DEG_LAT * 0.99)
    lon_step = lat_step / F.greatest(F.least(F.cos(F.radians(F.col("_band"))), F.cos(F.radians(F.col("_band") + 1.0))), F.lit(0.01))
    for lv in range(1, levels + 1):
        cells = cells.withColumns({
            f"_y{lv}": F.floor(F.col("lat") / (lat_step / 2 ** lv)),
            f"_x{lv}": F.floor(F.col("lon") / (lon_step / 2 ** lv))})
    cells = cut_lineage(cells.withColumnsRenamed({"_cy": "_y0", "_cx": "_x0"}))
    cell_key = lambda lv: [*keys, "_band", f"_y{lv}", f"_x{lv}"]

    def summary(lv):
        up = [f"_y{lv - 1}", f"_x{lv - 1}"] if lv else []
        return cells.groupBy(*cell_key(lv), *up).agg(*[f(f"_{c}").alias(f"{n}{c}") for c in "xyz" for n, f in
                                                        (("lo", F.min), ("hi", F.max))])

    def bounds(df):
        gap = lambda c: F.greatest(F.col(f"lo{c}") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"hi{c}"), F.lit(0.0))
        far = lambda c: F.greatest(F.abs(F.col(f"lo{c}") - F.col(f"p{c}")), F.abs(F.col(f"hi{c}") - F.col(f"p{c}")))
        return df.withColumns({"_lb": sum((gap(c) ** 2 for c in "xyz"), F.lit(0.0)),
                               "_ub": sum((far(c) ** 2 for c in "xyz"), F.lit(0.0))})

    slack = 1.0 + 1e-9
    reach2 = metres * metres * slack

    def prune(df):
        best = df.groupBy("_lid").agg(F.min("_ub").alias("_best"))
        return (df.join(best, "_lid")
                .where((F.col("_lb") <= F.col("_best") * slack + 1e-9) & (F.col("_lb") <= reach2)))

    point = [F.col(f"_{c}").alias(f"p{c}") for c in "xyz"]
    start = _neighbour_cells(lpos, metres, "lat", "lon").withColumnsRenamed({"_cy": "_y0", "_cx": "_x0"})
    frontier = prune(bounds(start.select("_lid", *keys, *point, "_band", "_y0", "_x0").join(summary(0), cell_key(0))))
    for lv in range(1, levels + 1):
        up = [*keys, "_band", f"_y{lv - 1}", f"_x{lv - 1}"]
        opened = frontier.select("_lid", "px", "py", "pz", *up).join(summary(lv), up)
        frontier = cut_lineage(prune(bounds(opened)).select("_lid", "px", "py", "pz", *cell_key(lv)))
    last = frontier.join(cells.select(*cell_key(levels), "_rid", "_x", "_y", "_z"), cell_key(levels))
    dist = arc_from_chord(*[F.col(f"p{c}") - F.col(f"_{c}") for c in "xyz"])
    best = (last.withColumn("distance_m", dist).where(F.col("distance_m") <= metres)
            .groupBy("_lid").agg(F.min(F.struct("distance_m", "_rid")).alias("m")))
    # every copy of a left position gets the answer of its position
    by_pos = lpos.join(best, "_lid").select(*pos, "m")
    return (left.join(by_pos, pos)
            .select(left_id, F.col("m._rid").alias(f"near_{right_id}"), F.col("m.distance_m").alias("distance_m")))
