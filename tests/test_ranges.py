"""Logger files by byte ranges: the frames of one pass, wherever the ranges start and whatever the samples hold."""
import struct

import numpy as np
import pyarrow as pa
import pytest

from pingframe.sources import decoders as D
from pingframe.sources import logs
from pingframe.sources import ranges as R

from .test_logs import slx


def jsf(n, samples, subsystem=20, kind=80):
    h = bytearray(240)
    struct.pack_into("<I", h, 8, n)
    struct.pack_into("<H", h, 114, len(samples) // 2)
    body = bytes(h) + samples
    return struct.pack("<HBBHBBBBHI", 0x1601, 10, 0, kind, 2, subsystem, n % 2, 0, 0, len(body)) + body


def jsf_file(seed, frames=120):
    """Traces of uneven length; some samples are whole messages, and chains of them, that a guess may fall for."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(frames):
        if r.random() < 0.2:
            out.append(jsf(i, b"".join(jsf(900 + k, r.bytes(40)) for k in range(12))))
        elif r.random() < 0.1:
            out.append(jsf(i, r.bytes(2 * int(r.integers(0, 2000))), kind=82))
        else:
            out.append(jsf(i, r.bytes(2 * int(r.integers(0, 300)))))
    return out


def whole(kind, blob, path="file:/x"):
    decode = {"jsf": D.jsf_frames, "slx": D.slx_frames}[kind]
    return pa.Table.from_batches(list(decode(path, blob)) or [], pa.schema([(n, D.arrow_type(k)) for n, k in (c.split() for c in R.FORMATS[kind].schema.split(", "))])).to_pylist()


def by_ranges(spark, folder, kind, length):
    suffixes = {"jsf": [".jsf"], "slx": [".sl2", ".sl3"]}[kind]
    got = R.logger_frames(spark, str(folder), kind, suffixes, length).collect()
    return sorted((tuple(r) for r in got), key=lambda t: (t[0], t[1], t[-1] or ""))


@pytest.mark.parametrize("kind", ["jsf", "slx"])
def test_ranges_of_any_length_give_the_frames_of_one_pass(spark, tmp_path, kind):
    if kind == "jsf":
        blobs = {"a.JSF": b"".join(jsf_file(1)), "cut.jsf": b"".join(jsf_file(2))[:-7], "empty.jsf": b"", "bad.jsf": b"".join(jsf_file(3, 30)) + b"\0" * 20 + b"".join(jsf_file(4, 60)),
                 "short.jsf": b"".join(jsf_file(5, 9)) + struct.pack("<HBBHBBBBHI", 0x1601, 10, 0, 80, 2, 20, 1, 0, 0, 100) + bytes(100) + jsf(1, b"ab"), "one.jsf": jsf(1, bytes(60000))}
    else:
        r = np.random.default_rng(7)
        frames = [{"channel": 5, "frame_index": i, "samples": list(r.bytes(int(r.integers(0, 900))))} for i in range(150)]
        blobs = {"a.SL2": slx(2, frames), "b.sl3": slx(3, frames), "cut.sl2": slx(2, frames)[:-3], "bad.sl3": slx(3, frames[:40]) + bytes(4000), "none.sl2": b"abc", "other.sl2": b"\7" * 5000}
    for name, blob in blobs.items():
        (tmp_path / name).write_bytes(blob)
    (tmp_path / "notes.txt").write_bytes(b"?" * 5000)
    names = [c.split()[0] for c in R.FORMATS[kind].schema.split(", ")]
    want = sorted((tuple(x[n] for n in names) for name, blob in blobs.items() for x in whole(kind, blob, f"file:{tmp_path}/{name}")), key=lambda t: (t[0], t[1], t[-1] or ""))
    for length in (1 << 20, 20_000, 3001):
        assert by_ranges(spark, tmp_path, kind, length) == want


def test_a_file_cut_or_damaged_anywhere_is_as_in_one_pass():
    """Ranges of 1 KB of one file, judged as a job judges them, for a file cut at many bytes."""
    form, blob = R.FORMATS["jsf"], b"".join(jsf_file(6, 25))
    for cut in [*range(0, 300, 7), *range(300, len(blob), 997), len(blob) - 1]:
        data = blob[:cut]
        size, got, due, rounds = len(data), [], None, 0
        for start in range(0, max(size, 1), 1024):
            stop = min(start + 1024, max(size, 1))
            if start and (due is None or due >= stop):
                continue
            *batches, (entered, led) = R.frames_in(form, "p", lambda a, b: data[a:min(b, size)], size, start, stop, 0 if start == 0 else None)
            if start and entered != due:
                *batches, (entered, led) = R.frames_in(form, "p", lambda a, b: data[a:min(b, size)], size, start, stop, due)
                rounds += 1
            got += [x for b in batches for x in b.to_pylist()]
            due = led
        assert got == whole("jsf", data, "p"), cut


def test_a_large_sparse_file_is_many_partitions(tmp_path):
    with open(tmp_path / "big.jsf", "wb") as f:
        f.truncate(3 << 30)
    parts = R.RangeReader("jsf", str(tmp_path), [".jsf"], R.RANGE).partitions()
    assert len(parts) == 96 and parts[0].entry == 0 and all(p.entry is None for p in parts[1:])
    assert [(p.start, p.stop) for p in parts] == [(i * R.RANGE, (i + 1) * R.RANGE) for i in range(96)]
    assert R.RangeReader("jsf", f"file:{tmp_path}/big.jsf", [".jsf"], 1 << 30).partitions()[-1].stop == 3 << 30


def test_archive_tables_do_not_depend_on_the_ranges(spark, tmp_path):
    (tmp_path / "line 01.jsf").write_bytes(b"".join(jsf_file(8)))
    (tmp_path / "007.sl2").write_bytes(slx(2, [{"channel": 5, "frame_index": i, "samples": [1, 2, 3, i]} for i in range(99)]))
    one, two = ([sorted(map(str, t.collect())) for t in logs.scan_surveys(spark, str(tmp_path), n)] for n in (1 << 25, 700))
    assert one == two and len(one[0]) > 300 and "007.sl2" in one[1][0]
