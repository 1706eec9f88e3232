"""Injected detectors: user code over bounded batches of tile tensors, with checked boxes out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditioning import SIDE, tiles_of
from .detections import tile_detections_to_global
from .joins import range_join

#: What a detector returns for a batch of tiles, as columns of equal length.
BOXES = {"tile": np.int64, "x1": np.float64, "y1": np.float64, "x2": np.float64, "y2": np.float64, "cls": object, "score": np.float64}
OUT = "survey string, side string, tile_index long, det_id string, x1 double, y1 double, x2 double, y2 double, cls string, score double"
#: Tiles a detector sees at once.
BATCH = 16

#: tensor (n, h, w) of float32, NaN beyond the swath -> columns of BOXES; `tile` counts within the tensor.
Detect = Callable[[np.ndarray], dict]

_opened: tuple[str, Detect] | None = None      # of this worker: the latest detector only


def _open(token: str, factory: Callable[[], Detect]) -> Detect:
    """The factory's detector, opened once in a worker, which serves many tasks."""
    global _opened
    if _opened is None or _opened[0] != token:
        _opened = None                         # let go of another one before this is loaded
        _opened = (token, factory())
    return _opened[1]


def checked_boxes(found: dict, n: int) -> dict[str, np.ndarray]:
    """The columns of a detector's answer in their types; anything else than BOXES, or values that mean nothing, is an error."""
    if set(found) != set(BOXES):
        raise ValueError(f"a detector returns {sorted(BOXES)}; missing {sorted(set(BOXES) - set(found))}, unknown {sorted(set(found) - set(BOXES))}")
    got = {c: np.asarray(found[c], kind) for c, kind in BOXES.items()}
    if len({x.shape for x in got.values()}) != 1 or got["tile"].ndim != 1:
        raise ValueError("a detector's columns are of equal length and one dimension")
    if len(got["tile"]) and not (0 <= got["tile"].min() and got["tile"].max() < n):
        raise ValueError(f"tile numbers lie in [0, {n})")
    if not all(np.isfinite(got[c]).all() for c in ("x1", "y1", "x2", "y2", "score")):
        raise ValueError("boxes and scores are finite")
    if not ((got["x1"] <= got["x2"]) & (got["y1"] <= got["y2"])).all() or not ((got["score"] >= 0) & (got["score"] <= 1)).all():
        raise ValueError("a box has x1 <= x2 and y1 <= y2, and a score lies in [0, 1]")
    return got


class _Tiles:
    """Tiles put together from their pixel rows, which come tile by tile; batches hold tiles of one shape."""

    def __init__(self, most: int):
        self.most, self.keys, self.tensors, self.at = most, [], [], None

    def add(self, key: tuple, h: int, w: int) -> np.ndarray:
        self.at = key
        self.keys.append(key)
        self.tensors.append(np.full((h, w), np.nan, np.float32))
        return self.tensors[-1]

    def full(self, h: int, w: int) -> bool:
        return bool(self.keys) and (len(self.keys) == self.most or self.tensors[-1].shape != (h, w))

    def taken(self) -> tuple[list[tuple], np.ndarray]:
        keys, tensors = self.keys, np.stack(self.tensors)
        self.keys, self.tensors = [], []
        return keys, tensors


def _batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple], np.ndarray]]:
    tiles, now = _Tiles(most), None
    for b in rows:
        survey, side = b.column(0), b.column(1)
        index, r, h, w = (b.column(i).to_numpy() for i in range(2, 6))
        cols = b.column(6)
        at, flat = cols.offsets.to_numpy(), cols.values.to_numpy(zero_copy_only=False)     # nulls become NaN
        for i in range(b.num_rows):
            key = (survey[i].as_py(), side[i].as_py(), int(index[i]))
            if key != tiles.at:
                if tiles.full(h[i], w[i]):
                    yield tiles.taken()
                now = tiles.add(key, h[i], w[i])
            line = flat[at[i]:at[i + 1]]
            now[r[i], :len(line)] = line
    if tiles.keys:
        yield tiles.taken()


def detect_tiles(ground: DataFrame, tiles: DataFrame, factory: Callable[[], Detect], batch: int = BATCH, bucket: int = 256) -> DataFrame:
    """Boxes in tile pixels (survey, side, tile_index, det_id, x1, y1, x2, y2, cls, score) that an injected detector finds.

    `ground` has the ping rows (survey, side, ping, cols), `tiles` the tiles
    (row0, col0, h, w, tile_index).  `factory` is sent to the workers, and each
    opens its detector once.  A detector gets at most `batch` tiles of one shape
    at a time, never a survey; which ones depends on the partitioning, so it has
    to treat tiles one by one.  Its answer is checked.  `det_id` is the tile's
    place in the survey and the box's rank by (y1, x1, y2, x2, cls, score) in it,
    the same for any partitioning.  A tile without pixel rows is not looked at.
    """
    token = uuid.uuid4().hex
    t = tiles.select(*SIDE, "tile_index", "row0", "col0", "h", "w", (F.col("row0") + F.col("h") - 1).alias("_r1"))
    rows = range_join(ground, t, SIDE, "ping", "row0", "_r1", bucket).select(
        *SIDE, F.col("tile_index").cast("long"), (F.col("ping") - F.col("row0")).cast("long").alias("r"), F.col("h").cast("long"), F.col("w").cast("long"),
        F.slice("cols", F.col("col0") + 1, F.col("w")).cast("array<float>").alias("cols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tensors in _batches(batches, batch):
            found = checked_boxes(_open(token, factory)(tensors), len(keys))
            order = np.lexsort([found[c].astype(str) if c == "cls" else found[c] for c in ("score", "cls", "x2", "y2", "x1", "y1", "tile")])
            found = {c: x[order] for c, x in found.items()}
            tile = found["tile"]
            first = np.searchsorted(tile, tile)
            at = [keys[i] for i in tile]
            ids = [f"{s}|{d}|{k}|{n}" for (s, d, k), n in zip(at, np.arange(len(tile)) - first)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in at], pa.string()), pa.array([k[1] for k in at], pa.string()), pa.array([k[2] for k in at], pa.int64()), pa.array(ids, pa.string()),
                                              *(pa.array(found[c]) for c in ("x1", "y1", "x2", "y2")), pa.array(found["cls"].tolist(), pa.string()), pa.array(found["score"])],
                                             [c.split()[0] for c in OUT.split(", ")])

    return rows.repartition(*SIDE, "tile_index").sortWithinPartitions(*SIDE, "tile_index", "r").mapInArrow(run, OUT)


def detect(ground: DataFrame, shape: DataFrame, factory: Callable[[], Detect], tile: int = 512, overlap: float = 0.25, min_content: float = 0.0,
           brain: str = "A", batch: int = BATCH) -> DataFrame:
    """Detections (survey, side, tile_index, det_id, cls, score, brain, box in survey pixels) of an injected detector over all tiles of a ground image."""
    tiles = tiles_of(ground, shape, tile, overlap, min_content)
    return tile_detections_to_global(detect_tiles(ground, tiles, factory, batch), tiles).withColumn("brain", F.lit(brain))
