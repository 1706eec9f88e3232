"""SQL fragments shared by the oracles (DuckDB dialect)."""

import math

A, FL = 6378137.0, 1.0 / 298.257223563
E2, R = FL * (2.0 - FL), 6371008.8


def ecef(lat, lon):
    n = f"({A!r} / sqrt(1 - {E2!r} * pow(sin(radians({lat})), 2)))"
    return (f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))",
            f"{n} * {1 - E2!r} * sin(radians({lat}))")


def dist(lat1, lon1, lat2, lon2):
    p, q = ecef(lat1, lon1), ecef(lat2, lon2)
    s = " + ".join(f"pow(({a}) - ({b}), 2)" for a, b in zip(p, q))
    return f"(2 * {R!r} * asin(sqrt({s}) / (2 * {R!r})))"


def iou(a="a", b="b"):
    h = f"greatest(least({a}.ping1, {b}.ping1) - greatest({a}.ping0, {b}.ping0) + 1, 0)"
    w = f"greatest(least({a}.col1, {b}.col1) - greatest({a}.col0, {b}.col0) + 1, 0)"
    area = lambda t: f"({t}.ping1 - {t}.ping0 + 1) * ({t}.col1 - {t}.col0 + 1)"
    return f"(CAST({h} * {w} AS DOUBLE) / ({area(a)} + {area(b)} - {h} * {w}))"


def local_xy(lat0, lon0, lat, lon):
    p, q = ecef(lat0, lon0), ecef(lat, lon)
    dx, dy, dz = (f"(({b}) - ({a}))" for a, b in zip(p, q))
    la, lo = f"radians({lat0})", f"radians({lon0})"
    e = f"(-sin({lo}) * {dx} + cos({lo}) * {dy})"
    n = f"(-sin({la}) * cos({lo}) * {dx} - sin({la}) * sin({lo}) * {dy} + cos({la}) * {dz})"
    d = f"(2 * {R!r} * asin(least(sqrt({dx}*{dx} + {dy}*{dy} + {dz}*{dz}) / (2 * {R!r}), 1)))"
    return e, n, d


PI = math.pi
