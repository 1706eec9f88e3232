"""The whole conditioning chain as one lazy plan over all surveys at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conditioning as C
from ..operators.filters import blank_water_column
from ..session import cut_lineage


@dataclass
class Conditioned:
    bottom: DataFrame
    first_return: DataFrame
    grid: DataFrame
    gain: DataFrame
    ground_raw: DataFrame
    ground: DataFrame
    tiles: DataFrame


def condition(traces: DataFrame, nav: DataFrame, n_bins: int = 256, nadir_guard: int = 8, fill: float = 0.0,
              ground_res: float | None = None, method: str | None = "lee", clahe: bool = True, tile: int = 512,
              overlap: float = 0.25, min_content: float = 0.0, normalise: bool = True) -> Conditioned:
    """Track -> gain -> blank -> ground range -> speckle -> contrast -> tiles.

    `ground_raw` is written once: the physics rules and the enhanced imagery both read it.
    """
    geom = cut_lineage(C.survey_geometry(traces, nav))
    bottom, first = C.track_bottom(traces, nav, geom)
    work, gain = traces, None
    if normalise:
        gain = cut_lineage(C.gain_curves(C.gain_bins(traces, first, n_bins, nadir_guard), geom, n_bins))
        work = C.salted_join(traces, gain, C.SIDE, "ping").join(first, [*C.SIDE, "ping"]).select(
            *C.SIDE, "ping", C.normalise_gain("samples", "gain", "first_return").alias("samples"))
    blank = work.join(first, [*C.SIDE, "ping"]).select(
        *C.SIDE, "ping", blank_water_column("samples", "first_return", fill).alias("samples"))
    grid = C.ground_grid(geom, bottom, ground_res)
    raw = cut_lineage(C.slant_to_ground(blank, first, bottom, grid))
    ground = C.despeckle(raw, grid, method) if method else raw
    if clahe:
        ground = C.equalise(ground, grid)
    ground = cut_lineage(ground)
    return Conditioned(bottom, first, grid, gain, raw, ground, C.tiles_of(ground, grid, tile, overlap, min_content))


def altitude_violations(bottom: DataFrame) -> DataFrame:
    """Pings that cannot be corrected: altitude missing or not positive."""
    bad = F.col("altitude_m").isNull() | (F.col("altitude_m") <= 0)
    return bottom.where(bad)
