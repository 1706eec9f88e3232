"""Byte-level decoding of logger files into frame rows.

Each format is declared as numpy records with field offsets.  A file is cut
into blocks of frame starts, and a whole block's fields are gathered at once;
blocks leave as Arrow batches, so the rows held at a time are bounded by
``BLOCK``.  Everything after framing is DataFrame work (`logs.py`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from struct import Struct

import numpy as np
import pyarrow as pa

#: Frames decoded at a time.
BLOCK = 512


def _record(size: int, /, **fields: tuple[str, int]) -> np.dtype:
    """A record of `size` bytes from name = (number type, offset)."""
    return np.dtype({"names": list(fields), "formats": [t for t, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": size})


# ---- fixed values of the formats ---------------------------------------------
JSF_MARKER, JSF_TRACE = 0x1601, 80
JSF_MESSAGE = _record(16, marker=("<u2", 0), kind=("<u2", 4), subsystem=("u1", 7), channel=("u1", 8), size=("<u4", 12))
JSF_HEADER = _record(240, time=("<i4", 0), ping=("<u4", 8), coord_x=("<i4", 80), coord_y=("<i4", 84), units=("<i2", 88), n=("<u2", 114),
                     interval_ns=("<u4", 116), depth_mm=("<i4", 136), altitude_mm=("<i4", 144), sound_speed=("<f4", 148),
                     weight=("<i2", 168), heading_cdeg=("<i2", 172))
SLX_START = 8
SLX_HEADER = {
    2: _record(144, frame_size=("<u2", 28), channel=("<u2", 32), packet_size=("<u2", 34), frame_index=("<u4", 36), lower_ft=("<f4", 44),
               depth_ft=("<f4", 64), speed_kn=("<f4", 100), x=("<i4", 108), y=("<i4", 112), course=("<f4", 120), heading=("<f4", 128), time_ms=("<u4", 140)),
    3: _record(168, frame_size=("<u2", 8), channel=("<u2", 12), packet_size=("<u2", 44), frame_index=("<u4", 16), lower_ft=("<f4", 24),
               depth_ft=("<f4", 48), speed_kn=("<f4", 84), x=("<i4", 92), y=("<i4", 96), course=("<f4", 104), heading=("<f4", 112), time_ms=("<u4", 124),
               epoch=("<u4", 40)),
}
SON_HEAD, SON_END, SON_SAMPLES = b"\xc0\xde\xab\x21", b"\x21", 0xA0
# tags with a four-byte value, then those with a one-byte value
SON_WIDE = bytes([0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x92, 0x95, 0xA0])
SON_SHORT = bytes([0x50, 0x51, 0x53, 0x54, 0x56, 0x57])
# column: (tag, type of its value)
SON_FIELDS = {"time_ms": (0x81, ">u4"), "e": (0x82, ">i4"), "n": (0x83, ">i4"), "heading_ddeg": (0x84, ">u2"), "speed_cms": (0x85, ">u2"), "depth_cm": (0x87, ">u4")}
DAT_HEADER = _record(56, sonar=(">u4", 4), unix_time=(">u4", 20), n_records=(">u4", 44))

JSF_SCHEMA = ("path string, offset long, subsystem int, channel int, time long, ping long, coord_x int, coord_y int, units int, "
              "interval_ns long, depth_mm int, altitude_mm int, sound_speed float, heading_cdeg int, weight int, "
              "samples array<double>, error string")
SLX_SCHEMA = ("path string, offset long, fmt int, channel int, frame_index long, lower_ft float, depth_ft float, speed_kn float, x int, y int, "
              "course float, heading float, time_ms long, epoch long, samples array<double>, error string")
SON_SCHEMA = ("path string, record int, time_ms long, e int, n int, heading_ddeg int, speed_cms int, depth_cm long, "
              "samples array<double>, error string")
DAT_SCHEMA = "path string, unix_time long, sonar long, n_records long, error string"

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "array<double>": pa.list_(pa.float64())}


def arrow_type(kind: str) -> pa.DataType:
    return _ARROW[kind]


# ---- blocks of frames to Arrow -----------------------------------------------

def batch(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    """Arrow rows of a schema: arrays by column, scalars (all strings) repeated, columns not named null."""
    names, types = zip(*(c.split() for c in schema.split(",")))
    out = []
    for name, kind in zip(names, types):
        v, t = columns.get(name), _ARROW[kind]
        if v is None:
            out.append(pa.nulls(rows, t))
        elif isinstance(v, pa.Array):
            out.append(v)
        else:
            out.append(pa.array([v] * rows, t) if kind == "string" else pa.array(np.broadcast_to(v, (rows,)).astype(t.to_pandas_dtype())))
    return pa.RecordBatch.from_arrays(out, names=list(names))


def _gather(data: np.ndarray, starts: np.ndarray, record: np.dtype) -> np.ndarray:
    """The records that begin at `starts`."""
    return data[starts[:, None] + np.arange(record.itemsize)].view(record).ravel()


def _samples(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """One list of numbers per frame, over one flat buffer."""
    width = np.dtype(kind).itemsize
    ends = begins + counts.astype(np.int64) * width
    flat = np.concatenate([data[b:e] for b, e in zip(begins, ends)] or [data[:0]]).view(kind).astype(float)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))


def _starts(buf: bytes, first: int, stop: int, end: int, head: int, size_of: Callable[[int], int]) -> Iterator[tuple[np.ndarray, int]]:
    """(block of frame starts before `stop`, where its last frame leads): a frame begins where the sizes before it end, as long as its head fits before `end`."""
    block, at = [], first
    while at < stop and at + head <= end:
        block.append(at)
        at += max(size_of(at), head)
        if len(block) == BLOCK:
            yield np.array(block, np.int64), at
            block = []
    if block:
        yield np.array(block, np.int64), at


def _sound(*faults: np.ndarray) -> tuple[int, int | None]:
    """(frames before the first fault, which fault that is; none: no fault)."""
    which = np.select(faults, range(1, len(faults) + 1), 0)
    bad = np.flatnonzero(which)
    return (int(bad[0]), int(which[bad[0]]) - 1) if len(bad) else (len(which), None)


def _columns(records: np.ndarray, schema: str) -> dict[str, np.ndarray]:
    return {n: records[n] for n in records.dtype.names if f" {n} " in f" {schema}"}


# ---- formats -----------------------------------------------------------------

def jsf_frames(path: str, buf: bytes) -> Iterator[pa.RecordBatch]:
    """Sonar traces of a .jsf; a cut-off last message ends the file quietly, any other fault is an error row and ends it."""
    return (b for b, _ in jsf_part(path, buf, b"", 0, 0, len(buf), len(buf)) if b is not None)


def jsf_sizes(data: np.ndarray, starts: np.ndarray, preamble: bytes) -> np.ndarray:
    """Bytes of the message at each start, 0 where none can be."""
    msg = _gather(data, starts, JSF_MESSAGE)
    return np.where(msg["marker"] == JSF_MARKER, 16 + msg["size"].astype(np.int64), 0)


def jsf_part(path: str, buf: bytes, preamble: bytes, base: int, first: int, stop: int, total: int) -> Iterator[tuple[pa.RecordBatch | None, int | None]]:
    """(batch, where the file goes on) for the messages that begin in [first, stop) of `buf`, which lies at `base` of a file of `total` bytes; null: it ends."""
    data, size, end = np.frombuffer(buf, np.uint8), Struct("<I"), total - base
    faults = ("bad message marker", None, "trace header too short", "trace samples cut off")
    at = first
    for starts, at in _starts(buf, first, stop, end, JSF_MESSAGE.itemsize, lambda at: 16 + size.unpack_from(buf, at + 12)[0]):
        msg = _gather(data, starts, JSF_MESSAGE)
        body = starts + JSF_MESSAGE.itemsize
        trace = (msg["kind"] == JSF_TRACE) & (msg["subsystem"] != 0)
        marker, cut = msg["marker"] != JSF_MARKER, body + msg["size"] > end
        short = trace & (msg["size"] < JSF_HEADER.itemsize)
        whole = np.flatnonzero(trace & ~cut & ~short)
        head = _gather(data, body[whole], JSF_HEADER)
        few = np.zeros(len(starts), bool)
        few[whole] = JSF_HEADER.itemsize + 2 * head["n"].astype(np.int64) > msg["size"][whole]
        n, fault = _sound(marker, cut, short, few)
        kept = whole < n
        i, h = whole[kept], head[kept]
        yield batch(JSF_SCHEMA, len(i), path=path, offset=base + starts[i], subsystem=msg["subsystem"][i], channel=msg["channel"][i],
                    samples=_samples(data, body[i] + JSF_HEADER.itemsize, h["n"], "<u2"), **_columns(h, JSF_SCHEMA)), None
        if fault is not None:
            if faults[fault]:
                yield batch(JSF_SCHEMA, 1, path=path, offset=base + starts[n:n + 1], error=faults[fault]), None
            return
    yield None, base + at if at + JSF_MESSAGE.itemsize <= end else None


def slx_frames(path: str, buf: bytes) -> Iterator[pa.RecordBatch]:
    """Frames of a .sl2/.sl3; a frame whose sizes do not fit is an error row and ends the file."""
    return (b for b, _ in slx_part(path, buf, buf[:SLX_START], 0, SLX_START, len(buf), len(buf)) if b is not None)


def _slx_record(preamble: bytes) -> tuple[int, np.dtype | None]:
    fmt = int.from_bytes(preamble[:2], "little") if len(preamble) >= SLX_START else 0
    return fmt, SLX_HEADER.get(fmt)


def slx_sizes(data: np.ndarray, starts: np.ndarray, preamble: bytes) -> np.ndarray:
    """Bytes of the frame at each start, 0 where its sizes do not fit."""
    _, record = _slx_record(preamble)
    if record is None:
        return np.zeros(len(starts), np.int64)
    size, packet = (_gather(data, starts + record.fields[c][1], np.dtype("<u2")).astype(np.int64) for c in ("frame_size", "packet_size"))
    return np.where(size >= record.itemsize + packet, size, 0)


def slx_part(path: str, buf: bytes, preamble: bytes, base: int, first: int, stop: int, total: int) -> Iterator[tuple[pa.RecordBatch | None, int | None]]:
    """As jsf_part(), for frames of a .sl2/.sl3 whose first bytes are `preamble`."""
    fmt, record = _slx_record(preamble)
    if record is None:
        yield batch(SLX_SCHEMA, 1, path=path, offset=0, error="not an sl2/sl3 file"), None
        return
    data, size, end = np.frombuffer(buf, np.uint8), Struct("<H"), total - base
    where, at = record.fields["frame_size"][1], first
    for starts, at in _starts(buf, first, stop, end, record.itemsize, lambda at: size.unpack_from(buf, at + where)[0]):
        head = _gather(data, starts, record)
        frame, packet = head["frame_size"].astype(np.int64), head["packet_size"].astype(np.int64)
        n, fault = _sound((frame < record.itemsize + packet) | (starts + frame > end))
        h = head[:n]
        yield batch(SLX_SCHEMA, n, **({"epoch": 0} | _columns(h, SLX_SCHEMA)), path=path, offset=base + starts[:n], fmt=fmt,
                    samples=_samples(data, starts[:n] + record.itemsize, packet[:n], "u1")), None
        if fault is not None:
            yield batch(SLX_SCHEMA, 1, path=path, offset=base + starts[n:n + 1], error="corrupt frame"), None
            return
    yield None, base + at if at + record.itemsize <= end else None


_SON_TAG = b"(?:[" + re.escape(SON_WIDE) + b"].{4}|[" + re.escape(SON_SHORT) + b"].)"
_SON_HEADER = re.compile(re.escape(SON_HEAD) + b"(" + _SON_TAG + b"*+)" + re.escape(SON_END), re.DOTALL)
_SON_VALUE = re.compile(_SON_TAG, re.DOTALL)


def _son_header(buf: bytes, at: int) -> tuple[dict[int, bytes], int, int] | None:
    """(values by tag, first sample, samples) of the record that begins at `at`, if a whole one does."""
    m = _SON_HEADER.match(buf, at)
    tags = {t[0]: t[1:] for t in _SON_VALUE.findall(m[1])} if m else {}
    n = int.from_bytes(tags.get(SON_SAMPLES, b""), "big")
    return (tags, m.end(), n) if SON_SAMPLES in tags and m.end() + n <= len(buf) else None


def _son_starts(buf: bytes, idx: bytes | None) -> Iterator[tuple[int, tuple | None]]:
    """(start, header) of the records an index names (offset in its second number), or of each mark beyond the samples before it."""
    if idx is not None:
        for at in np.frombuffer(idx, ">u4", len(idx) // 8 * 2)[1::2].tolist():
            yield at, _son_header(buf, at)
        return
    free = 0
    for mark in re.finditer(re.escape(SON_HEAD), buf):
        if mark.start() >= free:
            got = _son_header(buf, mark.start())
            free = got[1] + got[2] if got else free
            yield mark.start(), got


def son_frames(path: str, buf: bytes, idx: bytes | None) -> Iterator[pa.RecordBatch]:
    """Records of a beam file; one that cannot be read is an error row and ends the file. Missing tags are 0."""
    data, block, done = np.frombuffer(buf, np.uint8), [], 0

    def flush() -> pa.RecordBatch:
        # a value shorter than its four bytes' field keeps its low end
        fields = {c: np.array([int(np.frombuffer(t.get(tag, bytes(4)).rjust(4, b"\0")[-np.dtype(k).itemsize:], k)[0]) for t, _, _ in block])
                  for c, (tag, k) in SON_FIELDS.items()}
        begins, counts = np.array([b for _, b, _ in block], np.int64), np.array([n for _, _, n in block], np.int64)
        return batch(SON_SCHEMA, len(block), path=path, record=done + np.arange(len(block)), samples=_samples(data, begins, counts, "u1"), **fields)

    for _, header in _son_starts(buf, idx):
        if header is None:
            if block:
                yield flush()
            yield batch(SON_SCHEMA, 1, path=path, record=done + len(block), error="bad record")
            return
        block.append(header)
        if len(block) == BLOCK:
            yield flush()
            done, block = done + BLOCK, []
    if block:
        yield flush()
    elif done == 0:
        yield batch(SON_SCHEMA, 1, path=path, record=0, error="no records")


def dat_header(path: str, buf: bytes) -> Iterator[pa.RecordBatch]:
    if len(buf) < DAT_HEADER.itemsize:
        yield batch(DAT_SCHEMA, 1, path=path, error="header too short")
        return
    yield batch(DAT_SCHEMA, 1, path=path, **_columns(np.frombuffer(buf, DAT_HEADER, 1), DAT_SCHEMA))
