"""Retrieval zones, survey diffs, cross-view confirmation and recovery tours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANOMALY_CLASS
from ..functions.columns import half_even
from ..functions.geodesy import WGS84_A, WGS84_E2, MEAN_R, arc_from_chord, ecef, short_distance_m
from ..functions.scoring import confirmed_confidence, unconfirmed_confidence
from ..session import cut_lineage
from .components import connected_components
from .joins import nearest_within, radius_pairs
from .scale import ranked, running_sums

ZONE_MEMBERS = 5_000        # stops of a strip: larger tours are visited strip by strip


# ---- single-linkage zones ----------------------------------------------------

def _small_cells(df: DataFrame, eps_m: float) -> DataFrame:
    """Cells so small that every two points of one cell are within eps (side eps / (2 sqrt 2))."""
    side = eps_m / (2.0 * math.sqrt(2.0)) * 0.99
    step = side / 111_700.0                                   # a degree of latitude is never longer
    band = F.floor("lat")
    widest = F.greatest(F.cos(F.radians(band)), F.cos(F.radians(band + 1.0)))
    lon_step = step / F.greatest(widest, F.lit(1e-3))
    return df.withColumns({"_cy": F.floor(F.col("lat") / step), "_cx": F.floor(F.col("lon") / lon_step),
                           "_band": band.cast("int")})


def linkage_labels(contacts: DataFrame, eps_m: float, keys: tuple[str, ...] = ("survey",)) -> DataFrame:
    """Single-linkage label (smallest id of the zone) per contact.

    Points sharing a small cell are linked without looking at pairs; cells next
    to each other are linked by their bounding boxes when the boxes prove it.
    Only cells of different components that still may touch are compared point
    by point, and there one point per position.
    """
    keys = list(keys)
    pts = _small_cells(contacts.select("id", *keys, "lat", "lon"), eps_m)
    cell = [*keys, "_band", "_cy", "_cx"]
    x, y, z = ecef("lat", "lon")
    nodes = cut_lineage(
        pts.withColumns({"x": x, "y": y, "z": z}).groupBy(*cell).agg(
            F.min("id").alias("node"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
            F.min("lat").alias("lat"), F.min("lon").alias("lon")))
    # boxes of two cells: closest and farthest possible distance
    near = _cell_neighbours(nodes, eps_m, keys)
    gap = lambda c: F.greatest(F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.lit(0.0))
    far = lambda c: F.greatest(F.col(f"a_hi{c}") - F.col(f"b_lo{c}"), F.col(f"b_hi{c}") - F.col(f"a_lo{c}"))
    lo = F.sqrt(sum((gap(c) ** 2 for c in "xyz"), F.lit(0.0)))
    hi = arc_from_chord(far("x"), far("y"), far("z"))
    pairs = cut_lineage(near.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= eps_m)
                        .select("a_node", "b_node", "_hi"))
    sure = pairs.where(F.col("_hi") <= eps_m).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    comp = connected_components(nodes.select("node"), sure, "node")
    # doubtful cell pairs between different components
    c1, c2 = comp.select(F.col("node").alias("a_node"), F.col("label").alias("la")), \
        comp.select(F.col("node").alias("b_node"), F.col("label").alias("lb"))
    doubt = (pairs.where(F.col("_hi") > eps_m).join(c1, "a_node").join(c2, "b_node").where("la <> lb")
             .select("a_node", "b_node", "la", "lb"))
    member = (pts.join(nodes.select(*cell, "node"), cell).groupBy("node", "lat", "lon").agg(F.min("id").alias("pid"))
              .withColumns({"x": x, "y": y, "z": z}).drop("lat", "lon"))
    a = member.select(F.col("node").alias("a_node"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = member.select(F.col("node").alias("b_node"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    dist = arc_from_chord(*[F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"])
    links = (doubt.join(a, "a_node").join(b, "b_node").where(dist <= eps_m)
             .select(F.col("la").alias("src"), F.col("lb").alias("dst")).distinct())
    merged = connected_components(comp.select(F.col("label").alias("node")).distinct(), links, "node")
    label = comp.join(merged.select(F.col("node").alias("label"), F.col("label").alias("zone")), "label").select("node", "zone")
    return cut_lineage(pts.join(nodes.select(*cell, "node"), cell).join(label, "node").select("id", *keys, "zone"))


def _cell_neighbours(nodes: DataFrame, eps_m: float, keys: list[str]) -> DataFrame:
    """Pairs of cells (a < b by node) of the same keys close enough to be compared."""
    # a cell's corner point within eps plus two cell diagonals bounds every candidate
    reach = 2.2 * eps_m
    cols = ["node", *[f"{n}{c}" for c in "xyz" for n in ("lo", "hi")]]
    return radius_pairs(nodes.select(*keys, *cols, "lat", "lon"), nodes.select(*keys, *cols, "lat", "lon"), reach, keys,
                        lp="a_", rp="b_", extra=F.col("a_node") < F.col("b_node")).drop("a_lat", "a_lon", "b_lat", "b_lon")


def zones(contacts: DataFrame, labels: DataFrame, min_size: int = 1) -> DataFrame:
    """Severity-weighted centroid, total severity and size per zone."""
    joined = contacts.join(labels.select("id", "zone"), "id")
    sums = joined.groupBy("survey", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum("severity").alias("total_severity"),
        F.sum(F.col("lat") * F.col("severity")).alias("wl"), F.sum(F.col("lon") * F.col("severity")).alias("wo"),
        F.avg("lat").alias("ml"), F.avg("lon").alias("mo"))
    weighted = F.col("total_severity") > 0
    total = F.nullif(F.col("total_severity"), F.lit(0.0))
    return (sums.where(F.col("n") >= min_size).select(
        "survey", "zone", "n", "total_severity",
        F.when(weighted, F.col("wl") / total).otherwise(F.col("ml")).alias("centroid_lat"),
        F.when(weighted, F.col("wo") / total).otherwise(F.col("mo")).alias("centroid_lon"))
        .orderBy(F.desc("total_severity"), "zone"))


# ---- survey diff and cross-view ----------------------------------------------

def diff_surveys(a: DataFrame, b: DataFrame, radius_m: float = 25.0, digits: int | None = 1) -> DataFrame:
    """Every contact of b with its nearest contact of a within the radius, else marked new; distances to `digits` decimals, or as they are."""
    near = nearest_within(b, a, radius_m, "id", "id")
    return (b.join(near, "id", "left")
            .withColumns({"status": F.when(F.col("near_id").isNull(), F.lit("new")).otherwise(F.lit("matched")),
                          "distance_m": F.col("distance_m") if digits is None else half_even("distance_m", digits)})
            .withColumnRenamed("near_id", "a_id"))


def classes_agree(a: Column, b: Column) -> Column:
    return (a == b) | (a == ANOMALY_CLASS) | (b == ANOMALY_CLASS)


def confirm_candidates(a: DataFrame, b: DataFrame, radius_m: float = 15.0) -> DataFrame:
    """Pairs within the radius whose classes agree."""
    return radius_pairs(a.select("id", "cls", "lat", "lon"), b.select("id", "cls", "lat", "lon"), radius_m,
                        extra=classes_agree(F.col("l_cls"), F.col("r_cls"))).select(
        F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id"), "distance_m")


def greedy_nearest_pairs(pairs: DataFrame, a: str = "a_id", b: str = "b_id", dist: str = "distance_m") -> DataFrame:
    """One-to-one pairs equal to taking (distance, a, b) in order: rounds of pairs best for both ends."""
    rest = cut_lineage(pairs.select(a, b, dist))
    taken = None
    while True:
        key = F.struct(dist, a, b)
        best_a = rest.groupBy(a).agg(F.min(key).alias("k"))
        best_b = rest.groupBy(b).agg(F.min(key).alias("k"))
        mutual = cut_lineage(best_a.join(best_b.select(F.col("k").alias("kb"), F.col(b).alias("_b")),
                                         (F.col(f"k.{b}") == F.col("_b")) & (F.col("k") == F.col("kb")))
                             .select(F.col(f"k.{a}").alias(a), F.col(f"k.{b}").alias(b), F.col(f"k.{dist}").alias(dist)))
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = cut_lineage(rest.join(mutual.select(a), a, "left_anti").join(mutual.select(b), b, "left_anti"))
        if rest.isEmpty():
            return taken


def cross_confirm(a: DataFrame, b: DataFrame, radius_m: float = 15.0, boost: float = 1.15, demote: float = 0.85) -> DataFrame:
    """Both passes' contacts with adjusted confidence: confirmed pairs go up, lone contacts down."""
    pairs = greedy_nearest_pairs(confirm_candidates(a, b, radius_m))
    sides = []
    for df, me, other in ((a, "a_id", "b_id"), (b, "b_id", "a_id")):
        p = pairs.select(F.col(me).alias("id"), F.col(other).alias("partner_id"), "distance_m")
        out = df.join(p, "id", "left")
        found = F.col("partner_id").isNotNull()
        sides.append(out.withColumns({
            "pass": F.lit(me[0]), "status": F.when(found, F.lit("confirmed")).otherwise(F.lit("only")),
            "adjusted_confidence": F.when(found, confirmed_confidence("confidence", boost)).otherwise(
                unconfirmed_confidence("confidence", demote)),
            "resurvey_recommended": ~found}))
    return sides[0].unionByName(sides[1])


# ---- tours -------------------------------------------------------------------

def _ecef_np(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(la) ** 2)
    return np.stack([n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1 - WGS84_E2) * np.sin(la)], -1)


def _arc(chord):
    return 2 * MEAN_R * np.arcsin(np.minimum(chord / (2 * MEAN_R), 1.0))


def _nearest_first(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Nearest-neighbour order from index 0 (ties: smallest index); visited stops are taken out each time half are gone."""
    n = len(x)
    order, rest = np.zeros(n, dtype=np.int64), np.arange(1, n)
    at, done = 0, np.zeros(n - 1)
    rx, ry, rz = x[1:], y[1:], z[1:]
    open_ = n - 1
    for k in range(1, n):
        if 2 * open_ < len(rest):
            stay = done == 0
            rest, rx, ry, rz, done = rest[stay], rx[stay], ry[stay], rz[stay], done[stay]
        near = int(((rx - x[at]) ** 2 + (ry - y[at]) ** 2 + (rz - z[at]) ** 2 + done).argmin())
        done[near] = np.inf
        open_ -= 1
        order[k] = at = rest[near]
    return order


def tour(lat: np.ndarray, lon: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Nearest-neighbour order from index 0 followed by 2-opt; O(n) memory.

    Chords are never longer than arcs, so arcs are worked out only where the
    chords shorten the tour; the chords from a stop serve it and the next one.
    """
    n = len(lat)
    if not n:
        return np.zeros(0, dtype=np.int64)
    x, y, z = (np.ascontiguousarray(c) for c in _ecef_np(lat, lon).T)
    order = _nearest_first(x, y, z)
    x, y, z = x[order], y[order], z[order]           # points in tour order, so every scan is a slice
    chords = lambda u, v: np.sqrt((x[u] - x[v]) ** 2 + (y[u] - y[v]) ** 2 + (z[u] - z[v]) ** 2)
    edge = _arc(chords(slice(None, -1), slice(1, None)))
    for _ in range(rounds):
        better = False
        before = chords(0, slice(0, None))           # from stop i - 1 to the stops from there on
        for i in range(1, n - 2):
            here = chords(i, slice(i, None))
            j = i + 1
            while j < n - 1:
                # next j that shortens the tour when stops i..j are turned round
                to_j, to_next, now = before[j - i + 1:n - i], here[j + 1 - i:], edge[i - 1] + edge[j:n - 1] - 1e-9
                maybe = np.flatnonzero((to_j + to_next) * (1 - 1e-12) < now)
                if len(maybe):
                    maybe = maybe[_arc(to_j[maybe]) + _arc(to_next[maybe]) < now[maybe]]
                if not len(maybe):
                    break
                j += int(maybe[0])
                for v in (order, x, y, z):
                    v[i:j + 1] = v[i:j + 1][::-1].copy()
                edge[i - 1:j + 1] = _arc(chords(slice(i - 1, j + 1), slice(i, j + 2)))
                better = True
                j += 1
                here = chords(i, slice(i, None))
            before = here
        if not better:
            break
    return order


def _strips(df: DataFrame, keys: list[str], stops: int) -> DataFrame:
    """Adds `part`: strips of `stops` neighbouring contacts per group, by latitude, longitude and id; the last may be shorter."""
    strip = ranked(df, keys, [F.asc("lat"), F.asc("lon"), F.asc("id")], "_r")
    return strip.withColumn("part", F.floor((F.col("_r") - 1) / stops).cast("int")).drop("_r")


def _legs(lat: np.ndarray, lon: np.ndarray, before: tuple[float, float] | None) -> np.ndarray:
    """Leg to each stop from the one before it; the first from `before`, NaN without one."""
    p = _ecef_np(lat, lon)
    first = np.nan if before is None else _arc(np.linalg.norm(p[0] - _ecef_np(*before)))
    return np.r_[first, _arc(np.linalg.norm(np.diff(p, axis=0), axis=1))]


def _stitched(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Fills the legs that a strip's task could not know: from the stop before it in `seq`, wherever that was toured."""
    stops = cut_lineage(stops.withColumn("leg_m", F.when(~F.isnan("leg_m"), F.col("leg_m"))))
    open_ = F.col("leg_m").isNull() & (F.col("seq") > 1)
    before = stops.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    joined = (stops.where(open_).join(before, [*keys, "seq"])
              .withColumn("leg_m", short_distance_m("_plat", "_plon", "lat", "lon")).select(*stops.columns))
    return stops.where(~open_).unionByName(joined)


def zone_tours(contacts: DataFrame, by: tuple[str, ...] = ("survey", "zone"), start: tuple[float, float] | None = None,
               stops: int = ZONE_MEMBERS) -> DataFrame:
    """Visit order per group: adds `seq` (1-based, dense per group), `leg_m` (from the previous stop) and `part`.

    One rule for every size: a group is visited in strips of `stops` contacts
    (`part`), each toured in its own task.  The first strip starts at `start`, or
    else at its most severe contact; the others start at their first contact in
    strip order, and the leg that leads there comes from the last stop of the
    strip before.  A group of up to `stops` contacts is one strip.
    """
    keys = list(by)
    base = _strips(contacts.select(*keys, "id", "lat", "lon", "severity"), keys, stops)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", seq int, leg_m double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        if part:
            pdf = pdf.sort_values(["lat", "lon", "id"], ignore_index=True)
        else:
            pdf = pdf.sort_values(["severity", "id"], ascending=[False, True], ignore_index=True)
        before = None if part else start
        out = pdf.iloc[_order_from(before, pdf)].reset_index(drop=True)
        return out.assign(seq=np.arange(1, len(out) + 1, dtype=np.int32) + part * stops,
                          leg_m=_legs(out["lat"].to_numpy(float), out["lon"].to_numpy(float), before))

    # most zones are lone contacts: those need no tour and stay out of Python
    size = base.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_n"))
    sized = base.join(size, [*keys, "part"])
    nowhere = F.lit(None).cast("double")
    first_leg = nowhere if start is None else F.when(F.col("part") == 0, short_distance_m(start[0], start[1], "lat", "lon"))
    lone = sized.where("_n = 1").drop("_n").withColumns({"seq": (F.col("part") * stops + 1).cast("int"), "leg_m": first_leg})
    toured = sized.where("_n > 1").drop("_n").groupBy(*keys, "part").applyInPandas(run, schema)
    return _stitched(lone.unionByName(toured), keys)


def _order_from(before: tuple[float, float] | None, rows: pd.DataFrame) -> np.ndarray:
    """Tour of the rows from a position, or from the first row."""
    lat, lon = rows["lat"].to_numpy(float), rows["lon"].to_numpy(float)
    if before is None:
        return tour(lat, lon)
    return tour(np.r_[before[0], lat], np.r_[before[1], lon])[1:] - 1


def tour_legs(stops: DataFrame, keys: tuple[str, ...] = ("survey", "zone")) -> DataFrame:
    """Leg from the previous stop and total per tour, from an ordered stop table (`seq`)."""
    before = stops.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    leg = F.when(F.col("_plat").isNotNull(), short_distance_m("_plat", "_plon", "lat", "lon"))
    return stops.join(before, [*keys, "seq"], "left").withColumn("leg_m", leg).drop("_plat", "_plon")


def tour_totals(stops: DataFrame, keys: tuple[str, ...] = ("survey", "zone")) -> DataFrame:
    return stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("stops"),
                                    half_even(F.coalesce(F.sum("leg_m"), F.lit(0.0)), 1).alias("total_m"))


def cluster_tours(contacts: DataFrame, labels: DataFrame, start: tuple[float, float] | None = None,
                  stops: int = ZONE_MEMBERS, limit: int = ZONE_MEMBERS) -> DataFrame:
    """Two-level tour: zones in visiting order, members inside, each zone starting where the last ended; `seq` runs through the survey.

    Zones, and members of a zone, are cut into strips of `stops` as in
    `zone_tours`; that is part of the rule.  The chain from zone to zone is
    sequential, but a zone of one contact ends there whatever came before, and a
    later strip starts at its own first contact: at both the chain is cut, and
    the runs between are toured side by side.  A run of more than `limit`
    contacts (`stops` at least, so that no round is without a strip) takes
    several rounds, each going on from where the last one ended: `limit` bounds a
    task and never changes the answer.
    """
    z = zones(contacts, labels)
    by_zone = z.select("survey", F.col("zone").alias("id"), F.col("centroid_lat").alias("lat"),
                       F.col("centroid_lon").alias("lon"), F.col("total_severity").alias("severity"))
    visit = zone_tours(by_zone, ("survey",), start, stops).select("survey", F.col("id").alias("zone"), F.col("seq").alias("zone_seq"))
    rows = cut_lineage(_strips(contacts.select("id", "lat", "lon", "severity").join(labels.select("id", "survey", "zone"), "id"), ["survey", "zone"], stops))
    units = (rows.groupBy("survey", "zone", "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("lat", "lon")).alias("_at"))
             .join(visit, ["survey", "zone"]))
    units = cut_lineage(ranked(units, ["survey"], [F.asc("zone_seq"), F.asc("part")], "unit"))
    before = units.select("survey", (F.col("unit") + 1).alias("unit"), F.when(F.col("n") == 1, F.col("_at")).alias("_from"))
    here = F.lit(None).cast("struct<lat:double,lon:double>") if start is None else F.struct(F.lit(float(start[0])).alias("lat"), F.lit(float(start[1])).alias("lon"))
    units = (units.join(before, ["survey", "unit"], "left").withColumn("_from", F.when(F.col("part") > 0, None).when(F.col("unit") == 1, here).otherwise(F.col("_from")))
             .withColumn("fresh", ((F.col("unit") == 1) | (F.col("part") > 0) | F.col("_from").isNotNull()).cast("int")))
    units = running_sums(units, ["survey"], [F.asc("unit")], {"run": "fresh", "_cum": "n"})
    units = running_sums(units, ["survey", "run"], [F.asc("unit")], {"_load": "n"})
    units = units.select("survey", "zone", "part", "zone_seq", "unit", "run", "n", "fresh", F.col("_from.lat").alias("_slat"), F.col("_from.lon").alias("_slon"),
                         (F.col("_cum") - F.col("n")).alias("_before"), F.floor((F.col("_load") - F.col("n")) / max(limit, stops)).cast("int").alias("chunk"))
    rows = cut_lineage(rows.join(units, ["survey", "zone", "part"]))
    columns = ["survey", "run", "part", "zone", "zone_seq", "id", "seq", "lat", "lon", "severity", "leg_m"]
    schema = ("survey string, run long, part int, zone string, zone_seq int, id string, seq int, lat double, lon double, "
              "severity double, leg_m double")

    def tour_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "severity", "id"], ascending=[True, False, True])
        lat, lon = pdf["_slat"].iloc[0], pdf["_slon"].iloc[0]
        prev = None if np.isnan(lat) else (float(lat), float(lon))
        parts = []
        for _, unit in pdf.groupby("unit", sort=True):
            own = int(unit["part"].iloc[0]) > 0
            if own:
                unit = unit.sort_values(["lat", "lon", "id"])
            out = unit.iloc[_order_from(None if own else prev, unit)]
            at = out["lat"].to_numpy(float), out["lon"].to_numpy(float)
            parts.append(out.assign(seq=(out["_before"].iloc[0] + np.arange(1, len(out) + 1)).astype(np.int32), leg_m=_legs(*at, prev)))
            prev = float(at[0][-1]), float(at[1][-1])
        return pd.concat(parts)[columns]

    # a contact alone in its zone and in its run needs no Python
    alone = (F.col("n") == 1) & (F.col("fresh") == 1)
    done = [rows.where(alone).withColumns({"seq": (F.col("_before") + 1).cast("int"), "leg_m": short_distance_m("_slat", "_slon", "lat", "lon")})
            .select(*[F.col(c).cast(t) for c, t in (x.split() for x in schema.split(", "))])]
    rest, exits = rows.where(~alone), None
    for k in range(1 + int(rest.agg(F.max("chunk")).first()[0] or 0)):
        now = rest.where(F.col("chunk") == k)
        if exits is not None:
            now = now.drop("_slat", "_slon").join(exits, ["survey", "run"])
        got = cut_lineage(now.groupBy("survey", "run").applyInPandas(tour_run, schema))
        exits = got.groupBy("survey", "run").agg(F.max_by("lat", "seq").alias("_slat"), F.max_by("lon", "seq").alias("_slon"))
        done.append(got)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return _stitched(out, ["survey"])
