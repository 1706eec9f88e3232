"""WGS-84 positions and distances as column expressions.

Two families.  Survey-scale work (offsets of at most a swath, pairs within a
search radius, layers around a survey) uses closed forms that stay inside
whole-stage codegen: the chord-to-arc distance is within a millimetre up to
about 50 km, the second-order offset within 0.1 mm up to 1 km.  `geodesic_m`
is the general inverse solution with a fixed number of iterations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col, dbl

WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
MEAN_R = 6371008.8
SL_RADIUS = 6356752.3142          # mercator sphere of the .sl2/.sl3 loggers
DAT_RADIUS = 6378388.0            # mercator sphere of the .dat/.son loggers
DAT_LAT_STRETCH = 1.0067642927
EARTH_M_PER_DEG_LAT = 111320.0


def ecef(lat: ColumnLike, lon: ColumnLike) -> tuple[Column, Column, Column]:
    la, lo = F.radians(dbl(lat)), F.radians(dbl(lon))
    n = WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.sin(la) * F.sin(la))
    return n * F.cos(la) * F.cos(lo), n * F.cos(la) * F.sin(lo), n * (1.0 - WGS84_E2) * F.sin(la)


def with_ecef(df, lat: str, lon: str, prefix: str):
    """Precompute earth-centred coordinates once per row before a pair join."""
    x, y, z = ecef(lat, lon)
    return df.withColumns({f"{prefix}x": x, f"{prefix}y": y, f"{prefix}z": z})


def arc_from_chord(dx: Column, dy: Column, dz: Column) -> Column:
    half = F.sqrt(dx * dx + dy * dy + dz * dz) / (2.0 * MEAN_R)
    return 2.0 * MEAN_R * F.asin(F.when(half > 1.0, F.lit(1.0)).otherwise(half))     # NULL stays NULL


def short_distance_m(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    x1, y1, z1 = ecef(lat1, lon1)
    x2, y2, z2 = ecef(lat2, lon2)
    return arc_from_chord(x1 - x2, y1 - y2, z1 - z2)


def _let(value: Column, body) -> Column:
    """Bind a value once so that nested expressions do not repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geodesic_m(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike, rounds: int = 8) -> Column:
    """Vincenty inverse distance; coincident points give 0."""
    la1, la2 = F.radians(dbl(lat1)), F.radians(dbl(lat2))
    lam0 = F.radians(dbl(lon2) - dbl(lon1))
    u1, u2 = F.atan((1.0 - WGS84_F) * F.tan(la1)), F.atan((1.0 - WGS84_F) * F.tan(la2))
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"),
                     F.cos(u2).alias("c2"), lam0.alias("l0"))

    def angles(k, lam):
        """sigma, cos^2(alpha), cos(2 sigma_m), sin(alpha) for a longitude difference."""
        a, b = k["c2"] * F.sin(lam), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
        ss, cs = F.sqrt(a * a + b * b), k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)
        return F.struct(ss.alias("ss"), cs.alias("cs"), F.atan2(ss, cs).alias("sig"),
                        F.coalesce(F.try_divide(k["c1"] * k["c2"] * F.sin(lam), ss), F.lit(0.0)).alias("sa"))

    def widen(k, g):
        ca2 = 1.0 - g["sa"] * g["sa"]
        return F.struct(g["ss"].alias("ss"), g["cs"].alias("cs"), g["sig"].alias("sig"), g["sa"].alias("sa"),
                        ca2.alias("ca2"),
                        F.coalesce(g["cs"] - F.try_divide(2.0 * k["s1"] * k["s2"], ca2), F.lit(0.0)).alias("cm"))

    def solve(k, lam, body):
        return _let(angles(k, lam), lambda g: _let(widen(k, g), body))

    def step(k, lam):
        def update(g):
            c = WGS84_F / 16.0 * g["ca2"] * (4.0 + WGS84_F * (4.0 - 3.0 * g["ca2"]))
            return k["l0"] + (1.0 - c) * WGS84_F * g["sa"] * (
                g["sig"] + c * g["ss"] * (g["cm"] + c * g["cs"] * (2.0 * g["cm"] * g["cm"] - 1.0)))
        return solve(k, lam, update)

    def length(g):
        uu = g["ca2"] * (WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2
        big_a = 1.0 + uu / 16384.0 * (4096.0 + uu * (-768.0 + uu * (320.0 - 175.0 * uu)))
        big_b = uu / 1024.0 * (256.0 + uu * (-128.0 + uu * (74.0 - 47.0 * uu)))
        cm2 = g["cm"] * g["cm"]
        ds = big_b * g["ss"] * (g["cm"] + big_b / 4.0 * (
            g["cs"] * (2.0 * cm2 - 1.0)
            - big_b / 6.0 * g["cm"] * (4.0 * g["ss"] * g["ss"] - 3.0) * (4.0 * cm2 - 3.0)))
        return WGS84_B * big_a * (g["sig"] - ds)

    return _let(fixed, lambda k: _let(
        F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["l0"], lambda lam, _: step(k, lam)),
        lambda lam: solve(k, lam, length)))


def offset_position(lat: ColumnLike, lon: ColumnLike, azimuth_deg: ColumnLike, metres: ColumnLike) -> Column:
    """Position `metres` along an azimuth (second-order series, <= ~1 km)."""
    la, az, d = F.radians(dbl(lat)), F.radians(dbl(azimuth_deg)), dbl(metres)
    w2 = 1.0 - WGS84_E2 * F.sin(la) * F.sin(la)
    n = WGS84_A / F.sqrt(w2)
    m = n * (1.0 - WGS84_E2) / w2
    north, east = d * F.cos(az), d * F.sin(az)
    t = F.tan(la)
    dlat = (north / m - east * east * t / (2.0 * m * n)
            - 1.5 * WGS84_E2 * F.sin(la) * F.cos(la) * north * north / (w2 * m * m))
    dlon = (east / (n * F.cos(la))) * (1.0 + north * t / n)
    return F.struct((dbl(lat) + F.degrees(dlat)).alias("lat"), (dbl(lon) + F.degrees(dlon)).alias("lon"))


def towfish_position(lat: ColumnLike, lon: ColumnLike, heading: ColumnLike, layback_m: ColumnLike) -> Column:
    moved = offset_position(lat, lon, F.pmod(dbl(heading) + 180.0, F.lit(360.0)), layback_m)
    here = F.struct(dbl(lat).alias("lat"), dbl(lon).alias("lon"))
    return F.when(dbl(layback_m) > 0, moved).otherwise(here)


def across_track_position(lat: ColumnLike, lon: ColumnLike, heading: ColumnLike, side: ColumnLike,
                          ground_m: ColumnLike) -> Column:
    turn = F.when(col(side) == "port", F.lit(-90.0)).when(col(side) == "starboard", F.lit(90.0))
    return offset_position(lat, lon, F.pmod(dbl(heading) + turn, F.lit(360.0)), ground_m)


def pixel_position(fix: ColumnLike, side: ColumnLike, ground_m: ColumnLike) -> Column:
    """Nav fix struct(lat, lon, heading, layback) + pixel -> position; NULL without a fix."""
    f = col(fix)
    layback = F.coalesce(f["layback"], F.lit(0.0))
    return _let(towfish_position(f["lat"], f["lon"], f["heading"], layback),
                lambda p: across_track_position(p["lat"], p["lon"], f["heading"], side, ground_m))


def local_xy(lat0: ColumnLike, lon0: ColumnLike, lat: ColumnLike, lon: ColumnLike) -> tuple[Column, Column]:
    """East/north metres of a point in an equidistant plane centred on (lat0, lon0)."""
    la, lo = F.radians(dbl(lat0)), F.radians(dbl(lon0))
    x0, y0, z0 = ecef(lat0, lon0)
    x1, y1, z1 = ecef(lat, lon)
    dx, dy, dz = x1 - x0, y1 - y0, z1 - z0
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    flat = F.sqrt(east * east + north * north)
    scale = F.when(flat > 0, arc_from_chord(dx, dy, dz) / flat).otherwise(1.0)
    return east * scale, north * scale


def point_segment_m(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from the origin to a segment."""
    dx, dy = x1 - x0, y1 - y0
    seg2 = dx * dx + dy * dy
    t = F.when(seg2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x0 * dx + y0 * dy) / F.nullif(seg2, F.lit(0.0)))))
    t = F.coalesce(t, F.lit(0.0))
    px, py = x0 + t * dx, y0 + t * dy
    return F.sqrt(px * px + py * py)


def sl_mercator_to_lonlat(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(F.degrees(dbl(x) / SL_RADIUS).alias("lon"),
                    F.degrees(2.0 * F.atan(F.exp(dbl(y) / SL_RADIUS)) - F.pi() / 2.0).alias("lat"))


def dat_mercator_to_lonlat(e: ColumnLike, n: ColumnLike) -> Column:
    gd = 2.0 * F.atan(F.exp(dbl(n) / DAT_RADIUS)) - F.pi() / 2.0
    return F.struct(F.degrees(dbl(e) / DAT_RADIUS).alias("lon"),
                    F.degrees(F.atan(DAT_LAT_STRETCH * F.tan(gd))).alias("lat"))


def declared_track(ping: ColumnLike, lat0: ColumnLike, lon0: ColumnLike, heading: ColumnLike,
                   speed_mps: ColumnLike, dt_s: ColumnLike) -> Column:
    """Straight-line nav for imagery without its own fixes."""
    along = dbl(ping) * dbl(speed_mps) * dbl(dt_s)
    b = F.radians(dbl(heading))
    return F.struct(
        (dbl(lat0) + along * F.cos(b) / EARTH_M_PER_DEG_LAT).alias("lat"),
        (dbl(lon0) + along * F.sin(b) / (EARTH_M_PER_DEG_LAT * F.cos(F.radians(dbl(lat0))))).alias("lon"))


def heading_or_course(heading_rad: ColumnLike, course_rad: ColumnLike) -> Column:
    """Heading in degrees from 0 to 360; a heading of exactly 0 was not measured, and the course takes its place."""
    h = col(heading_rad)
    return F.pmod(F.degrees(F.when(h != 0, h).otherwise(col(course_rad)).cast("double")), F.lit(360.0))
