"""Logger files read by byte ranges: a Spark data source whose partitions start anywhere and find the frames themselves.

A range guesses where its first frame begins: the first place from which a
chain of frame sizes holds.  It decodes the frames that begin in it and notes
where it entered and where its last frame leads.  Guesses are then checked
along each file: the first range of a file is right, and a range is right if it
entered where the one before it led.  Only ranges that entered elsewhere are
read again, from the place they should have; so the frames are those of one
pass over the whole file, whatever the samples hold.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import written
from . import decoders as D

#: Bytes of a range; frames of a chain that make a guess.
RANGE = 32 << 20
CHAIN = 8
#: Columns before those of the frames: where the range lies, entered and led, in the one row of a range that has no frame.
HEAD = "file string, size long, start long, stop long, entered long, led long, "


@dataclass(frozen=True)
class Format:
    """How a file's frames are found in a part of it and decoded.

    `first`: where a file's first frame begins; `head`: the bytes that tell a
    frame's size; `reach`: the bytes of a frame that its row is made of, at most;
    `preamble`: the bytes of a file that its frames' layout depends on; `sizes`:
    the bytes from each start to the next frame, 0 where none can begin.
    """

    schema: str
    first: int
    head: int
    reach: int
    preamble: int
    sizes: Callable[[np.ndarray, np.ndarray, bytes], np.ndarray]
    decode: Callable[..., Iterator[pa.RecordBatch]]


FORMATS = {
    "jsf": Format(D.JSF_SCHEMA, 0, 16, 16 + D.JSF_HEADER.itemsize + 2 * 0xFFFF, 0, D.jsf_sizes, D.jsf_part),
    "slx": Format(D.SLX_SCHEMA, D.SLX_START, max(r.itemsize for r in D.SLX_HEADER.values()), 0xFFFF + max(r.itemsize for r in D.SLX_HEADER.values()), D.SLX_START, D.slx_sizes, D.slx_part),
}


def guessed_start(form: Format, data: np.ndarray, begin: int, stop: int, more: bool, preamble: bytes) -> int | None:
    """The first place in [begin, stop) from which `CHAIN` frames follow each other, or fewer to the end of what is read.

    `more`: the file goes on after `data`; a chain that leaves it holds as far
    as it was seen, if it has one step at least.
    """
    for low in range(begin, stop, 1 << 16):
        first = np.arange(low, min(stop, low + (1 << 16)))
        at, ok, steps = first.copy(), np.ones(len(first), bool), np.zeros(len(first), int)
        for _ in range(CHAIN):
            here = ok & (at + form.head <= len(data))
            size = np.zeros(len(first), np.int64)
            size[here] = form.sizes(data, at[here], preamble)
            ok &= ~here | (size > 0)                     # beyond the data nothing speaks against it
            at, steps = at + size, steps + (here & (size > 0))
        good = np.flatnonzero(ok & (steps > 0) & (more | (at <= len(data))))
        if len(good):
            return int(first[good[0]])
    return None


def frames_in(form: Format, path: str, read: Callable[[int, int], bytes], size: int, start: int, stop: int, entry: int | None) -> Iterator[pa.RecordBatch | tuple]:
    """Batches of the frames that begin in [start, stop), then (entered, led).

    `entry` is known for the first range of a file and for one that is read
    again.  Without any frame start nothing is entered.  A file ends at its first
    fault, as in one pass: it then leads nowhere (null).
    """
    preamble = read(0, form.preamble)
    begin = max(start, form.first if start == 0 else start)
    data = read(begin, min(size, stop + form.reach + 16))
    view = np.frombuffer(data, np.uint8)
    if entry is None:
        got = guessed_start(form, view, 0, max(0, stop - begin), begin + len(data) < size, preamble)
        entry = None if got is None else begin + got
    if entry is None:
        yield None, None
        return
    led = None
    if entry < stop or start == 0:
        for batch, led in form.decode(path, data, preamble, begin, entry - begin, stop - begin, size):
            if batch is not None:
                yield batch
    else:
        led = entry
    yield entry, led


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, prefix of names) of a path or URI that Arrow can open on every executor."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path, "file:"
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner, path[:path.index("://") + 3]


@dataclass
class Range(InputPartition):
    file: str
    size: int
    start: int
    stop: int
    entry: int | None


class RangeReader(DataSourceReader):
    def __init__(self, form: str, path: str, suffixes: Sequence[str], length: int):
        self.form, self.path, self.suffixes, self.length = form, path, tuple(suffixes), length

    def partitions(self) -> list[Range]:
        fs, base, prefix = file_system(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and posixpath.splitext(f.path)[1].lower() in self.suffixes:
                first = FORMATS[self.form].first
                out += [Range(prefix + f.path, f.size, s, min(s + self.length, max(f.size, 1)), first if s == 0 else None) for s in range(0, max(f.size, 1), self.length)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:                            # no file, no partition
            return iter(())
        return range_rows(FORMATS[self.form], partition.file, partition.size, partition.start, partition.stop, partition.entry)


def range_rows(form: Format, file: str, size: int, start: int, stop: int, entry: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of a range: its frames, then one row of its own with where it entered and led."""
    fs, inner, _ = file_system(file)
    schema = arrow_schema(form)

    def rows(batch: pa.RecordBatch, *mine) -> pa.RecordBatch:
        head = [pa.array([v] * batch.num_rows, t) for v, t in zip((file, size, start, stop, *mine), schema.types)]
        return pa.RecordBatch.from_arrays([*head, *batch.columns], schema=schema)

    with fs.open_input_file(inner) as f:
        def read(low: int, high: int) -> bytes:
            return f.read_at(max(0, min(high, size) - low), low) if low < size else b""

        for got in frames_in(form, file, read, size, start, stop, entry):
            if isinstance(got, tuple):
                yield rows(D.batch(form.schema, 1), *got)
            else:
                yield rows(got, -1, -1)


def arrow_schema(form: Format) -> pa.Schema:
    names = [c.split() for c in (HEAD + form.schema).split(", ")]
    return pa.schema([(n, D.arrow_type(k)) for n, k in names])


class FrameRanges(DataSource):
    """`spark.read.format("logger_ranges")` with options path, kind (jsf, slx), suffixes (comma-separated) and range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "logger_ranges"

    def schema(self) -> str:
        return HEAD + FORMATS[self.options["kind"]].schema

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self.options["kind"], self.options["path"], self.options["suffixes"].split(","), int(self.options.get("range", RANGE)))


def _judge(ranges: pd.DataFrame) -> pd.DataFrame:
    """Of one file's ranges: those that are right, and the first that has to be read again and from where."""
    due, out = None, []
    for i, r in enumerate(ranges.sort_values("start").itertuples(index=False)):
        entered, led = (None if pd.isna(x) else int(x) for x in (r.entered, r.led))
        if i and due is None:
            break                                        # the file ended before
        if i and due >= r.stop:
            continue                                     # a frame spans the range
        if i and entered != due:
            out.append((r.file, r.size, r.start, r.stop, due, False))
            break
        out.append((r.file, r.size, r.start, r.stop, entered, True))
        due = led
    return pd.DataFrame(out, columns=["file", "size", "start", "stop", "entered", "right"])


def logger_frames(spark: SparkSession, path: str, kind: str, suffixes: Sequence[str], length: int = RANGE) -> DataFrame:
    """The frames of all logger files of a kind under `path`, the same as decoding each file in one pass.

    Rows have the columns of the format's schema; a fault is a row with `error`
    and ends its file.  Ranges are decoded once into a table beside the
    checkpoints.  A wrong guess costs one more job for the next range of that
    file, and one for each further wrong one, as each shows the next.
    """
    form = FORMATS[kind]
    spark.dataSource.register(FrameRanges)
    load = spark.read.format("logger_ranges").options(kind=kind, path=path, suffixes=",".join(s.lower() for s in suffixes), range=str(length))
    rows = written(load.load())
    columns = [c.split()[0] for c in form.schema.split(", ")]
    frames = rows
    while True:
        mine = rows.where("coalesce(entered, 0) >= 0").select("file", "size", "start", "stop", "entered", "led")
        judged = mine.groupBy("file").applyInPandas(_judge, "file string, size long, start long, stop long, entered long, right boolean")
        judged = written(judged)
        wrong = judged.where("NOT right")
        if wrong.isEmpty():
            break
        schema = HEAD + form.schema

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    yield from range_rows(form, r["file"], r["size"], r["start"], r["stop"], r["entered"])

        redone = wrong.select("file", "size", "start", "stop", "entered").repartition("file", "start").mapInArrow(again, schema)
        rows = written(rows.join(wrong.select("file", "start"), ["file", "start"], "left_anti").select(*rows.columns).unionByName(redone))
    right = judged.where("right").select("file", "start")
    return rows.where("entered = -1").join(right, ["file", "start"], "left_semi").select(*columns)
