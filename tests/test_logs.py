"""Logger files made byte by byte: whole, cut off, damaged and foreign ones."""
import struct

import numpy as np
import pyarrow as pa
import pytest

from pingframe.sources import decoders as D
from pingframe.sources import logs


def rows(batches):
    return pa.Table.from_batches(list(batches)).to_pylist()


def slx(fmt, frames):
    head = D.SLX_HEADER[fmt]
    out = struct.pack("<HHHH", fmt, 0, 0, 0)
    for f in frames:
        h = np.zeros(1, head)
        packet = bytes(f["samples"])
        for k, v in ({"frame_size": head.itemsize + len(packet), "packet_size": len(packet)} | {k: v for k, v in f.items() if k != "samples"}).items():
            h[k] = v
        out += h.tobytes() + packet
    return out


def son(**tags):
    samples = bytes(tags.pop("samples"))
    order = {"time_ms": 0x81, "e": 0x82, "n": 0x83, "heading_ddeg": 0x84, "speed_cms": 0x85, "depth_cm": 0x87}
    body = b"".join(bytes([order[k]]) + struct.pack(">i", v) for k, v in tags.items()) + b"\x50\x02" + b"\xa0" + struct.pack(">I", len(samples))
    return D.SON_HEAD + body + b"\x21" + samples


@pytest.mark.parametrize("fmt", [2, 3])
def test_slx_frames(fmt):
    frames = [{"channel": 5, "frame_index": i, "time_ms": i * 100, "x": -i, "lower_ft": 10.0, "samples": range(i % 7)} for i in range(1098)]
    blob = slx(fmt, frames)
    got = rows(D.slx_frames("f", blob))
    assert [(r["frame_index"], r["time_ms"], r["x"], r["samples"]) for r in got] == [(i, i * 100, -i, list(range(i % 7))) for i in range(1098)]
    assert got[0]["epoch"] == 0 and got[0]["lower_ft"] == 10.0 and all(r["error"] is None for r in got)
    # a file that ends inside a frame's samples; one that ends inside a head; one with sizes that cannot be; no such file
    assert [r["error"] for r in rows(D.slx_frames("f", blob[:-1]))][-2:] == [None, "corrupt frame"]
    assert len(rows(D.slx_frames("f", slx(fmt, frames[:2]) + b"\1" * 20))) == 2
    assert [r["error"] for r in rows(D.slx_frames("f", slx(fmt, frames[:1]) + bytes(500)))] == [None, "corrupt frame"]
    assert [r["error"] for r in rows(D.slx_frames("f", b"\7\0\0\0\0\0\0\0"))] == ["not an sl2/sl3 file"]
    assert [r["error"] for r in rows(D.slx_frames("f", b""))] == ["not an sl2/sl3 file"]


def test_jsf_frames_in_blocks():
    h = bytearray(240)
    struct.pack_into("<H", h, 114, 3)
    def msg(n, size=246, marker=0x1601):
        struct.pack_into("<I", h, 8, n)
        return struct.pack("<HBBHBBBBHI", marker, 10, 0, 80, 2, 20, 1, 0, 0, size) + bytes(h) + struct.pack("<HHH", n % 9, 1, 65535)
    blob = b"".join(msg(i) for i in range(1030))
    got = rows(D.jsf_frames("f", blob))
    assert [(r["ping"], r["offset"], r["channel"], r["samples"]) for r in got] == [(i, i * 262, 1, [i % 9, 1, 65535]) for i in range(1030)]
    assert rows(D.jsf_frames("f", blob[:-1])) == got[:-1]
    assert [r["error"] for r in rows(D.jsf_frames("f", msg(1) + msg(2, marker=5) + msg(3)))] == [None, "bad message marker"]
    assert [r["error"] for r in rows(D.jsf_frames("f", msg(1) + msg(2, size=100)))] == [None, "trace header too short"]
    assert [r["error"] for r in rows(D.jsf_frames("f", msg(1) + msg(2, size=244)))] == [None, "trace samples cut off"]
    assert rows(D.jsf_frames("f", b"\x01\x16" + bytes(14))) == [] and list(D.jsf_frames("f", b"")) == []


def test_son_frames():
    # samples that hold the mark of a record, and a record without some tags
    recs = [son(time_ms=i * 50, e=-i, n=i, heading_ddeg=3599, depth_cm=250, samples=D.SON_HEAD + bytes([i % 251])) for i in range(600)] + [son(samples=b"")]
    blob = b"\0\0" + b"".join(recs)
    at = 2 + np.cumsum([0] + [len(r) for r in recs[:-1]])
    idx = np.stack([np.arange(601), at], 1).astype(">u4").tobytes()
    for got in (rows(D.son_frames("f", blob, idx)), rows(D.son_frames("f", blob, None))):
        assert [(r["record"], r["time_ms"], r["e"], r["n"]) for r in got] == [(i, i * 50, -i, i) for i in range(600)] + [(600, 0, 0, 0)]
        assert got[5]["samples"] == [0xC0, 0xDE, 0xAB, 0x21, 5] and got[600]["samples"] == [] and got[0]["heading_ddeg"] == 3599 and got[0]["depth_cm"] == 250
    cut = rows(D.son_frames("f", blob[:at[600] - 1], None))
    assert len(cut) == 600 and [r["error"] for r in cut][-2:] == [None, "bad record"] and cut[-1]["record"] == 599
    assert [r["error"] for r in rows(D.son_frames("f", b"nothing", None))] == ["no records"]
    assert [r["error"] for r in rows(D.son_frames("f", blob, struct.pack(">II", 0, 3)))] == ["bad record"]


def test_archive_of_all_formats(spark, tmp_path):
    (tmp_path / "A.SL2").write_bytes(slx(2, [{"channel": 5, "frame_index": i, "samples": [1, 2, 3, 4]} for i in (3, 1)]))
    (tmp_path / "b.sl3").write_bytes(slx(3, [{"channel": 0, "frame_index": 0, "epoch": 1000, "time_ms": 500, "samples": [7, 8]}]))
    (tmp_path / "rec.DAT").write_bytes(struct.pack(">14I", *[0, 1, 0, 0, 0, 1700000000, 0, 0, 0, 0, 0, 2, 0, 0]))
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "B002.SON").write_bytes(son(time_ms=10, samples=[1, 2]) + son(time_ms=20, samples=[3, 4]))
    (tmp_path / "rec" / "B003.SON").write_bytes(son(samples=[5, 6]))
    (tmp_path / "lone.dat").write_bytes(bytes(56))
    (tmp_path / "notes.xyz").write_bytes(b"?" * 10_000)
    (tmp_path / "bad.jsf").write_bytes(b"\0" * 40)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "9000")
    try:
        traces, nav, bad = logs.scan_surveys(spark, str(tmp_path))
        t = {(r.survey, r.side, r.ping): r.samples for r in traces.collect()}
        n = {(r.survey, r.ping): r.time for r in nav.collect()}
        errors = {(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()}
        plan = traces._jdf.queryExecution().toString() + nav._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert t == {("A.SL2", "port", 0): [2, 1], ("A.SL2", "starboard", 0): [3, 4], ("A.SL2", "port", 1): [2, 1], ("A.SL2", "starboard", 1): [3, 4],
                 ("b.sl3", "port", 0): [7, 8], ("b.sl3", "starboard", 0): [7, 8], ("rec.DAT", "port", 0): [1, 2], ("rec.DAT", "starboard", 0): [5, 6]}
    assert n == {("A.SL2", 0): 0.0, ("A.SL2", 1): 0.0, ("b.sl3", 0): 1000.5, ("rec.DAT", 0): 1700000000.01}
    # a foreign file over the size limit is listed, not read
    assert errors == {("notes.xyz", "unknown format"), ("bad.jsf", "bad message marker"), ("lone.dat", "sidescan beam missing")}
    assert "MapInArrow" not in plan      # files are decoded once, before these plans
