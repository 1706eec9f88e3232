"""Inclusive pixel boxes: overlap, tile mapping, chip windows, label lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, clamp, col, dbl

BOX = ("ping0", "ping1", "col0", "col1")


def box_of(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in BOX}


def box_area(b: dict[str, Column]) -> Column:
    return dbl((b["ping1"] - b["ping0"] + 1) * (b["col1"] - b["col0"] + 1))


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    h = F.least(a["ping1"], b["ping1"]) - F.greatest(a["ping0"], b["ping0"]) + 1
    w = F.least(a["col1"], b["col1"]) - F.greatest(a["col0"], b["col0"]) + 1
    return dbl(F.greatest(h, F.lit(0)) * F.greatest(w, F.lit(0)))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = box_intersection(a, b)
    return inter / (box_area(a) + box_area(b) - inter)


# ---- tiles -------------------------------------------------------------------

def tile_box_to_global(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike,
                       row0: ColumnLike, col0: ColumnLike, h: ColumnLike, w: ColumnLike) -> Column:
    """Continuous in-tile box -> inclusive global extents, clamped to the tile."""
    h, w = col(h).cast("long"), col(w).cast("long")
    c0 = clamp(F.floor(dbl(x1)), F.lit(0), w - 1)
    r0 = clamp(F.floor(dbl(y1)), F.lit(0), h - 1)
    c1 = F.greatest(clamp(F.ceil(dbl(x2)) - 1, F.lit(0), w - 1), c0)
    r1 = F.greatest(clamp(F.ceil(dbl(y2)) - 1, F.lit(0), h - 1), r0)
    row0, col0 = col(row0), col(col0)
    return F.struct((row0 + r0).cast("int").alias("ping0"), (row0 + r1).cast("int").alias("ping1"),
                    (col0 + c0).cast("int").alias("col0"), (col0 + c1).cast("int").alias("col1"))


def tile_contains(ping: ColumnLike, c: ColumnLike, row0: ColumnLike, col0: ColumnLike,
                  h: ColumnLike, w: ColumnLike) -> Column:
    r, k = col(ping) - col(row0), col(c) - col(col0)
    return (r >= 0) & (r < col(h)) & (k >= 0) & (k < col(w))


def global_to_tile(ping: ColumnLike, c: ColumnLike, row0: ColumnLike, col0: ColumnLike,
                   h: ColumnLike, w: ColumnLike) -> Column:
    """Tile-local (r, c); NULL when the pixel is outside the tile."""
    inside = tile_contains(ping, c, row0, col0, h, w)
    return F.when(inside, F.struct((col(ping) - col(row0)).alias("r"), (col(c) - col(col0)).alias("c")))


def axis_origins(extent: ColumnLike, tile: int, stride: int) -> Column:
    """Tile origins along one axis; the last tile is shifted to the edge, never padded."""
    n = col(extent).cast("int")
    last = F.greatest(n - tile, F.lit(0))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(
        F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


# ---- chips and labels --------------------------------------------------------

def chip_window(ping0: ColumnLike, ping1: ColumnLike, col0: ColumnLike, col1: ColumnLike,
                n_rows: ColumnLike, n_cols: ColumnLike, chip: int) -> Column:
    """Window centred on the box, shifted (not padded) to stay inside the image."""
    def axis(lo, hi, extent):
        size = F.least(F.lit(chip), col(extent).cast("int"))
        start = F.rint((dbl(lo) + dbl(hi) + 1.0) / 2.0 - size / 2.0).cast("int")
        return clamp(start, F.lit(0), col(extent).cast("int") - size), size

    r0, h = axis(ping0, ping1, n_rows)
    c0, w = axis(col0, col1, n_cols)
    return F.struct(r0.alias("row0"), c0.alias("col0"), h.alias("h"), w.alias("w"))


def label_line(class_id: ColumnLike, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", col(class_id).cast("int"), cx, cy, w, h)


def label_of_box(class_id: ColumnLike, ping0: ColumnLike, ping1: ColumnLike, col0: ColumnLike, col1: ColumnLike,
                 row_origin: ColumnLike, col_origin: ColumnLike, h: ColumnLike, w: ColumnLike) -> Column:
    """Label line of an inclusive global box inside a chip."""
    x0 = F.greatest(col(col0) - col(col_origin), F.lit(0))
    x1 = F.least(col(col1) - col(col_origin), col(w) - 1)
    y0 = F.greatest(col(ping0) - col(row_origin), F.lit(0))
    y1 = F.least(col(ping1) - col(row_origin), col(h) - 1)
    return label_line(class_id, (x0 + x1 + 1) / 2.0 / dbl(w), (y0 + y1 + 1) / 2.0 / dbl(h),
                      (x1 - x0 + 1) / dbl(w), (y1 - y0 + 1) / dbl(h))
