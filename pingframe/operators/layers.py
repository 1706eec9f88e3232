"""Sensitive areas: distance, containment, weighted nearest, contacts near a layer.

Segment table: layer, feature, name, kind, weight, ord (layer order), is_area,
outer (segment belongs to an outer ring), x0, y0, x1, y1 (lon/lat degrees).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even
from ..functions.geodesy import EARTH_M_PER_DEG_LAT, MEAN_R, WGS84_A, WGS84_E2, arc_from_chord, ecef
from ..functions.scoring import proximity_contribution

SEGMENT_LIMIT = 4096        # segments carried along with every contact; beyond it the bucketed search runs
FEATURE = ["layer", "feature", "name", "kind", "weight", "ord"]
PACKED = [*FEATURE, "is_area", "outer", "x0", "y0", "x1", "y1"]


def crosses_ray(lon: Column, lat: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an eastward ray from the point crosses the segment."""
    straddles = (y0 > lat) != (y1 > lat)
    at = (x0 - x1) * (lat - y1) / F.nullif(y0 - y1, F.lit(0.0)) + x1
    return F.coalesce(straddles & (lon < at), F.lit(False))


@dataclass(frozen=True)
class PackedLayers:
    """Every feature of a small layer set as flat arrays; shipped to tasks as a closure of at most SEGMENT_LIMIT segments."""

    features: list[tuple]            # FEATURE values, in layer order
    weight: np.ndarray               # per feature
    first: np.ndarray                # per feature: first segment row
    area: np.ndarray                 # per segment: counts for containment
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def distances(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """(points, features) metres; 0 inside an area."""
        dist, crossed = self.measured(lat, lon)
        return np.where(crossed % 2 == 1, 0.0, dist)

    def measured(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, features) metres to the nearest segment, and segments of areas that an eastward ray crosses."""
        la, lo = np.radians(lat)[:, None], np.radians(lon)[:, None]
        here = _ecef_np(lat, lon)
        frame_e = (-np.sin(lo), np.cos(lo))
        frame_n = (-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la))

        def plane(vlat, vlon):
            d = [v[None, :] - h[:, None] for v, h in zip(_ecef_np(vlat, vlon).T, here.T)]
            east = frame_e[0] * d[0] + frame_e[1] * d[1]
            north = frame_n[0] * d[0] + frame_n[1] * d[1] + frame_n[2] * d[2]
            flat = np.hypot(east, north)
            chord = np.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)
            arc = 2 * MEAN_R * np.arcsin(np.minimum(chord / (2 * MEAN_R), 1.0))
            k = np.divide(arc, flat, out=np.ones_like(flat), where=flat > 0)
            return east * k, north * k

        (ax, ay), (bx, by) = plane(self.y0, self.x0), plane(self.y1, self.x1)
        dx, dy = bx - ax, by - ay
        seg2 = dx * dx + dy * dy
        t = np.clip(np.divide(-(ax * dx + ay * dy), seg2, out=np.zeros_like(seg2), where=seg2 > 0), 0.0, 1.0)
        dist = np.minimum.reduceat(np.hypot(ax + t * dx, ay + t * dy), self.first, axis=1)
        y, x = lat[:, None], lon[:, None]
        rise = self.y0 - self.y1
        at = (self.x0 - self.x1) * (y - self.y1) / np.where(rise == 0, 1.0, rise) + self.x1
        cross = self.area & ((self.y0 > y) != (self.y1 > y)) & (x < at)
        return dist, np.add.reduceat(cross.astype(np.int64), self.first, axis=1)


def _ecef_np(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    n = WGS84_A / np.sqrt(1.0 - WGS84_E2 * np.sin(la) ** 2)
    return np.stack([n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1.0 - WGS84_E2) * np.sin(la)], axis=-1)


def pack_layers(segments: DataFrame, limit: int = SEGMENT_LIMIT) -> PackedLayers | None:
    """Collect a layer set of at most `limit` segments; None when there are more."""
    rows = segments.select(*PACKED).limit(limit + 1).collect()
    return None if len(rows) > limit else _packed(rows)


def _packed(rows: list) -> PackedLayers:
    rows = sorted(rows, key=lambda r: (r["ord"], r["layer"], r["feature"]))
    feats, first = [], []
    for i, r in enumerate(rows):
        key = tuple(r[c] for c in FEATURE)
        if not feats or feats[-1] != key:
            feats.append(key)
            first.append(i)
    arr = lambda c: np.array([r[c] for r in rows], dtype=float)
    return PackedLayers(feats, np.array([f[FEATURE.index("weight")] for f in feats], dtype=float), np.array(first, dtype=int),
                        np.array([bool(r["is_area"] and r["outer"]) for r in rows]), arr("x0"), arr("y0"), arr("x1"), arr("y1"))


def _pick(packed: PackedLayers, column: str, index: Column, kind: str) -> Column:
    """Feature attribute by position (literal array of at most a few hundred entries)."""
    values = [f[FEATURE.index(column)] for f in packed.features]
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def with_layer_distances(contacts: DataFrame, segments: DataFrame, limit: int = SEGMENT_LIMIT) -> DataFrame:
    """One row per contact and feature: `layer`, `feature`, `distance_m`, 0 inside an area.

    A layer set of at most `limit` segments is measured inside the contact scan.
    A larger one is read in blocks of so many segments, a pass over the contacts
    for each, and the blocks of a feature meet: the least distance, and all its
    ray crossings.  Contacts then need an `id`.
    """
    packed = pack_layers(segments, limit)
    if packed is not None and not packed.features:
        return contacts.select("*", F.lit(0.0).alias("distance_m"), F.lit("").alias("layer"), F.lit(0).alias("feature")).limit(0)
    if packed is not None:
        @F.pandas_udf("array<double>")
        def all_distances(lat: pd.Series, lon: pd.Series) -> pd.Series:
            return pd.Series(list(packed.distances(lat.to_numpy(float), lon.to_numpy(float))))

        rows = contacts.select("*", F.posexplode(all_distances("lat", "lon")).alias("_i", "distance_m"))
        return rows.withColumns({"layer": _pick(packed, "layer", F.col("_i"), "string"),
                                 "feature": _pick(packed, "feature", F.col("_i"), "int")}).drop("_i")
    points, block, out = contacts.select("id", "lat", "lon"), [], None
    for row in segments.select(*PACKED).orderBy("ord", "layer", "feature").toLocalIterator():
        block.append(row)
        if len(block) == limit:
            out, block = _and_block(out, points, _packed(block)), []
    if block:
        out = _and_block(out, points, _packed(block))
    met = out.groupBy("id", "layer", "feature").agg(F.min("d").alias("d"), F.sum("c").alias("c"))
    measured = met.select("id", F.when(F.col("c") % 2 == 1, 0.0).otherwise(F.col("d")).alias("distance_m"), "layer", "feature")
    return contacts.join(measured, "id").select(*contacts.columns, "distance_m", "layer", "feature")


def _and_block(out: DataFrame | None, points: DataFrame, packed: PackedLayers) -> DataFrame:
    """The rows so far and those of one more block of segments: (id, layer, feature, least distance, crossings)."""
    @F.pandas_udf("struct<d array<double>, c array<bigint>>")
    def measured(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        d, c = packed.measured(lat.to_numpy(float), lon.to_numpy(float))
        return pd.DataFrame({"d": list(d), "c": list(c)})

    rows = points.select("id", measured("lat", "lon").alias("m")).select("id", F.posexplode(F.arrays_zip("m.d", "m.c")).alias("_i", "m"))
    rows = rows.select("id", _pick(packed, "layer", F.col("_i"), "string").alias("layer"), _pick(packed, "feature", F.col("_i"), "int").alias("feature"), "m.d", "m.c")
    return rows if out is None else out.unionByName(rows)


def nearest_layer(contacts: DataFrame, segments: DataFrame, decay_m: float = 2000.0,
                  limit: int = SEGMENT_LIMIT) -> DataFrame:
    """Adds `proximity`, `nearest_layer`, `nearest_layer_kind`, `nearest_layer_distance_m`.

    Nearest means largest weight * exp(-distance/decay); on a tie the first
    feature in layer order.  A contribution of exactly 0 names no layer.  A layer
    set of at most `limit` segments is measured inside the contact scan without
    any shuffle; a larger one is searched by bucketed joins.
    """
    packed = pack_layers(segments, limit)
    if packed is None:
        return _nearest_layer_bucketed(contacts, segments, decay_m)
    if not packed.features:
        return _layer_columns(contacts.withColumn("_best", F.lit(None).cast(
            "struct<c:double,layer:string,name:string,kind:string,d:double>")))

    @F.pandas_udf("struct<i int, c double, d double>")
    def best_feature(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        d = packed.distances(lat.to_numpy(float), lon.to_numpy(float))
        c = packed.weight[None, :] * np.exp(-d / decay_m)
        i = c.argmax(axis=1)                                  # the first of equal maxima
        at = np.arange(len(i))
        return pd.DataFrame({"i": i.astype(np.int32), "c": c[at, i], "d": d[at, i]})

    found = contacts.withColumn("_b", best_feature("lat", "lon"))
    i = F.col("_b.i")
    best = F.when(F.col("_b.c") > 0, F.struct(
        F.col("_b.c").alias("c"), _pick(packed, "layer", i, "string").alias("layer"),
        _pick(packed, "name", i, "string").alias("name"), _pick(packed, "kind", i, "string").alias("kind"), F.col("_b.d").alias("d")))
    return _layer_columns(found.withColumn("_best", best)).drop("_b")


def _layer_columns(df: DataFrame) -> DataFrame:
    b = F.col("_best")
    return df.withColumns({
        "proximity": F.coalesce(b["c"], F.lit(0.0)),
        "nearest_layer": F.when(b.isNotNull(), F.coalesce(b["name"], b["layer"])),
        "nearest_layer_kind": b["kind"], "nearest_layer_distance_m": half_even(b["d"], 1)}).drop("_best")


# ---- many segments: bucketed joins -------------------------------------------

def _cells(lat: Column, lon: Column, deg: float) -> tuple[Column, Column]:
    return F.floor(lat / deg), F.floor(lon / deg)


def segment_hits(contacts: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """(contact, feature) pairs with a segment within `radius_m`, one row per pair, smallest distance.

    Segments are entered in every cell their box grown by the radius touches, so
    each contact looks in one cell only.
    """
    dlat = radius_m / (EARTH_M_PER_DEG_LAT * 0.99)
    deg = max(dlat, 1e-5)
    span = lambda lo, hi: F.sequence(F.floor(lo / deg), F.floor(hi / deg))
    top = F.greatest(F.abs("y0"), F.abs("y1")) + dlat
    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(F.least(top, F.lit(89.0)))), F.lit(0.01))
    seg = (segments.withColumn("_cy", F.explode(span(F.least("y0", "y1") - dlat, F.greatest("y0", "y1") + dlat)))
           .withColumn("_cx", F.explode(span(F.least("x0", "x1") - dlon, F.greatest("x0", "x1") + dlon))))
    def vertex(lat, lon, p):
        return [c.alias(f"{p}{n}") for n, c in zip("xyz", ecef(lat, lon))]

    seg = seg.select("_cy", "_cx", *FEATURE, *vertex("y0", "x0", "a"), *vertex("y1", "x1", "b"))
    cy, cx = _cells(F.col("lat"), F.col("lon"), deg)
    la, lo = F.radians("lat"), F.radians("lon")
    pts = contacts.select("id", cy.alias("_cy"), cx.alias("_cx"), *vertex("lat", "lon", "p"), (-F.sin(lo)).alias("ex"),
                          F.cos(lo).alias("ey"), (-F.sin(la) * F.cos(lo)).alias("nx"), (-F.sin(la) * F.sin(lo)).alias("ny"),
                          F.cos(la).alias("nz"))
    j = pts.join(seg, ["_cy", "_cx"])
    c = F.col
    # step by step, so that no expression is inlined several times; the radius is applied after the minimum
    for v in "ab":
        j = j.withColumns({f"{v}d{n}": c(f"{v}{n}") - c(f"p{n}") for n in "xyz"})
        j = j.withColumns({f"{v}e": c("ex") * c(f"{v}dx") + c("ey") * c(f"{v}dy"),
                           f"{v}n": c("nx") * c(f"{v}dx") + c("ny") * c(f"{v}dy") + c("nz") * c(f"{v}dz"),
                           f"{v}arc": arc_from_chord(c(f"{v}dx"), c(f"{v}dy"), c(f"{v}dz"))})
        j = j.withColumn(f"{v}flat", F.sqrt(c(f"{v}e") * c(f"{v}e") + c(f"{v}n") * c(f"{v}n")))
        j = j.withColumn(f"{v}k", F.coalesce(F.try_divide(c(f"{v}arc"), c(f"{v}flat")), F.lit(1.0)))
        j = j.withColumns({f"{v}e": c(f"{v}e") * c(f"{v}k"), f"{v}n": c(f"{v}n") * c(f"{v}k")})
    j = j.withColumns({"de": c("be") - c("ae"), "dn": c("bn") - c("an")})
    j = j.withColumn("t", F.coalesce(F.try_divide(-(c("ae") * c("de") + c("an") * c("dn")),
                                                  c("de") * c("de") + c("dn") * c("dn")), F.lit(0.0)))
    j = j.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("t"))))
    j = j.withColumns({"fe": c("ae") + c("t") * c("de"), "fn": c("an") + c("t") * c("dn")})
    return (j.groupBy("id", *FEATURE).agg(F.min(F.sqrt(c("fe") * c("fe") + c("fn") * c("fn"))).alias("distance_m"))
            .where(c("distance_m") <= radius_m))


def inside_features(contacts: DataFrame, segments: DataFrame, deg: float = 0.05) -> DataFrame:
    """(contact, feature) pairs where the contact lies inside an area (even-odd over outer rings)."""
    ring = segments.where(F.col("is_area") & F.col("outer"))
    box = ring.groupBy(*FEATURE).agg(F.min(F.least("x0", "x1")).alias("w"), F.max(F.greatest("x0", "x1")).alias("e"),
                                     F.min(F.least("y0", "y1")).alias("s"), F.max(F.greatest("y0", "y1")).alias("n"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / deg), F.floor(F.col(hi) / deg))
    box = box.withColumn("_cy", F.explode(span("s", "n"))).withColumn("_cx", F.explode(span("w", "e")))
    cy, cx = _cells(F.col("lat"), F.col("lon"), deg)
    near = (contacts.select("id", "lat", "lon").withColumns({"_cy": cy, "_cx": cx}).join(box, ["_cy", "_cx"])
            .where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
            .select("id", "lat", "lon", "_cy", *FEATURE))
    rows = ring.select(
        "layer", "feature", "x0", "y0", "x1", "y1",
        F.explode(F.sequence(F.floor(F.least("y0", "y1") / deg), F.floor(F.greatest("y0", "y1") / deg))).alias("_cy"))
    hit = crosses_ray(F.col("lon"), F.col("lat"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return (near.join(rows, ["layer", "feature", "_cy"]).where(hit)
            .groupBy("id", *FEATURE).agg(F.count(F.lit(1)).alias("crossings"))
            .where(F.col("crossings") % 2 == 1).drop("crossings"))


def _nearest_layer_bucketed(contacts: DataFrame, segments: DataFrame, decay_m: float,
                            first_radius_m: float = 2000.0) -> DataFrame:
    """Widening search: a contact is settled once nothing farther out can beat its best contribution."""
    from ..session import cut_lineage
    w_max = float(segments.agg(F.max("weight").alias("w")).first()["w"] or 0.0)
    best_of = lambda df: df.groupBy("id").agg(F.max(F.struct(
        proximity_contribution("weight", "distance_m", decay_m).alias("c"), (-F.col("ord")).alias("o"),
        (-F.col("feature")).alias("f"), "layer", "name", "kind", F.col("distance_m").alias("d"))).alias("_best"))
    inner = inside_features(contacts, segments).withColumn("distance_m", F.lit(0.0))
    open_, settled, radius = contacts.select("id", "lat", "lon"), None, first_radius_m
    while True:
        found = best_of(segment_hits(open_, segments, radius).unionByName(
            inner.join(open_.select("id"), "id", "left_semi")))
        state = cut_lineage(open_.join(found, "id", "left"))
        bound = proximity_contribution(w_max, radius, decay_m)
        last = radius >= 2.1e7 or radius > 750 * decay_m            # beyond it every contribution is 0
        done = F.lit(last) | F.coalesce(F.col("_best.c") >= bound, F.lit(False))
        part = state.where(done).select("id", "_best")
        settled = part if settled is None else settled.unionByName(part)
        open_ = state.where(~done).select("id", "lat", "lon")
        if last or open_.isEmpty():
            break
        radius *= 4
    best = settled.withColumn("_best", F.when(F.col("_best.c") > 0, F.col("_best")))
    return _layer_columns(contacts.join(best, "id", "left"))


def near_layer(contacts: DataFrame, segments: DataFrame, layer: str, radius_m: float = 2000.0) -> DataFrame:
    """Contacts within `radius_m` of a named layer with their distance, nearest feature counted once."""
    one = segments.where(F.col("layer") == layer)
    hits = segment_hits(contacts, one, radius_m).select("id", "distance_m")
    inner = inside_features(contacts, one).select("id", F.lit(0.0).alias("distance_m"))
    near = hits.unionByName(inner).groupBy("id").agg(F.min("distance_m").alias("distance_m"))
    return (contacts.join(near, "id").withColumn("distance_m", half_even("distance_m", 1))
            .orderBy("distance_m", "id"))


def square_segments(squares: DataFrame) -> DataFrame:
    """Segment columns completed for tables that only hold plain outer rings; layers in name order."""
    names = squares.agg(F.array_sort(F.collect_set("layer")).alias("_names")).withColumn("_k", F.lit(1))     # layer names only
    return (squares.withColumn("_k", F.lit(1)).join(names, "_k")
            .withColumns({"is_area": F.lit(True), "outer": F.lit(True), "ord": F.array_position("_names", F.col("layer")).cast("int")})
            .drop("_k", "_names"))
