"""Waterfall pictures made byte by byte: grey and coloured, combined and single, declared and undeclared, unreadable."""
import struct
import zlib

import numpy as np
import pytest

from pingframe.sources import logs


def png(pixels):
    m = np.asarray(pixels, np.uint8)
    h, w = m.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + m[r].tobytes() for r in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if m.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(grey):
    m = np.asarray(grey, np.uint8)[::-1]
    h, w = m.shape
    rows = b"".join(np.repeat(r, 3).tobytes() + bytes(-3 * w % 4) for r in m)
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


@pytest.fixture
def archive(tmp_path):
    r = np.random.default_rng(2)
    grey, colour, odd = r.integers(0, 256, (30, 8)), r.integers(0, 256, (12, 10, 3)), r.integers(0, 256, (5, 7))
    (tmp_path / "day").mkdir()
    for name, blob in (("grey.png", png(grey)), ("day/Colour.PNG", png(colour)), ("single.bmp", bmp(odd)), ("thin.png", png([[9], [8]])), ("broken.png", b"not a picture"), ("notes.txt", b"?")):
        (tmp_path / name).write_bytes(blob)
    return tmp_path, grey, colour, odd


def test_pictures_become_traces_and_declared_lines(spark, archive):
    path, grey, colour, odd = archive
    geometry = spark.createDataFrame([("grey.png", True, 13.0, 80.0, 0.0, 3.0, 0.5, 7.0, 40.0, 1000.0, 2.0), ("single.bmp", False, None, None, None, None, None, 5.0, None, None, None)], logs.GEOMETRY)
    traces, nav, bad = logs.scan_surveys(spark, str(path), geometry=geometry)
    t = {(r.survey, r.side, r.ping): r.samples for r in traces.collect()}
    luma = (colour[..., 0] * 19595 + colour[..., 1] * 38470 + colour[..., 2] * 7471 + 32768) >> 16
    for name, m, half in (("grey.png", grey, 4), ("Colour.PNG", luma, 5)):
        for p in range(len(m)):
            assert t.pop((name, "port", p)) == m[p, :half][::-1].tolist() and t.pop((name, "starboard", p)) == m[p, half:].tolist()
    for p in range(5):
        assert t.pop(("single.bmp", "port", p)) == [] and t.pop(("single.bmp", "starboard", p)) == odd[p].tolist()
    assert t == {("thin.png", "port", 0): [], ("thin.png", "starboard", 0): [9], ("thin.png", "port", 1): [], ("thin.png", "starboard", 1): [8]}
    n = {(r.survey, r.ping): r for r in nav.collect()}
    assert len(n) == 30 + 12 + 5 + 2
    g, c, s = n["grey.png", 4], n["Colour.PNG", 3], n["single.bmp", 1]
    assert (g.time, g.lon, g.heading, g.altitude, g.slant_range, g.sensor_depth, g.nav_source) == (1002.0, 80.0, 0.0, 7.0, 40.0, 2.0, "declared-line")
    assert g.lat == pytest.approx(13.0 + 4 * 1.5 / 111320.0, abs=1e-12)
    assert (c.time, c.lat, c.heading, c.speed, c.nav_source) == (None, None, 90.0, 2.0, "none") and (s.altitude, s.heading, s.nav_source) == (5.0, 90.0, "none")
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()} == {("broken.png", "unreadable image"), ("notes.txt", "unknown format")}


def test_a_large_picture_moves_row_by_row(spark, tmp_path):
    m = np.arange(3000 * 64, dtype=np.int64).reshape(3000, 64) % 251
    (tmp_path / "big.png").write_bytes(png(m))
    rows = logs.image_rows(spark.read.format("image").load(str(tmp_path)))
    assert {r.ping: r.pixels for r in rows.where("ping % 997 = 5").collect()} == {p: m[p].tolist() for p in range(5, 3000, 997)} and rows.count() == 3000
