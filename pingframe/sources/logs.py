"""Survey files -> traces and nav tables: format registry and per-format ingestion.

Decoded frames go through plain DataFrame steps; every format ends in the same
two tables.  Files that no format claims, and files that fail to decode, end in
a quarantine table instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions.geometry import slant_range_from_samples
from ..operators.conditioning import fit_width
from ..operators.scale import ranked, salted_join
from ..session import written
from . import decoders as D
from . import ranges as R

NAV = ["time", "lat", "lon", "heading", "altitude", "sensor_depth", "sound_velocity", "slant_range", "speed", "layback"]
FORMATS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]] = {}
RANGED: dict[Callable, str] = {}


def register_format(*suffixes: str):
    """Plug-in point: `fn(files) -> (traces, nav, errors)` for lowercase suffixes; later registrations win."""
    def wrap(fn):
        for s in suffixes:
            FORMATS[s.lower()] = fn
        return fn
    return wrap


def register_ranges(kind: str, *suffixes: str):
    """Plug-in point for formats of `ranges.FORMATS`: `fn(frames) -> (traces, nav, errors)`; their files are read by byte ranges."""
    def wrap(fn):
        register_format(*suffixes)(fn)
        RANGED[fn] = kind
        return fn
    return wrap


def list_files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """Files under `path` with their suffix; with suffixes (any case) only those are listed, and no other file's bytes are read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
        read = read.option("pathGlobFilter", "*{" + either + "}")
    return read.load(path).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def scan_surveys(spark: SparkSession, path: str, range_bytes: int = R.RANGE, geometry: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, nav, quarantine) of a mixed archive; files of no known format are only listed, never read.

    Files of the range formats are read in parts of `range_bytes`, however large
    they are.  Pictures are read by their declared `geometry`, see
    `ingest_images`; `nav_source` tells a declared line from a recorded one.
    """
    companions = [".son", ".idx"]
    bad = list_files(spark, path).where(~F.col("suffix").isin(*FORMATS, *companions, *IMAGES)).select("path", F.lit("unknown format").alias("error"))
    traces = nav = None
    for fn in dict.fromkeys(FORMATS.values()):
        mine = [s for s, f in FORMATS.items() if f is fn]
        if fn in RANGED:
            t, n, e = fn(R.logger_frames(spark, path, RANGED[fn], mine, range_bytes))
        else:
            t, n, e = fn(list_files(spark, path, *mine, *(companions if ".dat" in mine else [])))
        traces = t if traces is None else traces.unionByName(t)
        nav = n if nav is None else nav.unionByName(n)
        bad = bad.unionByName(e)
    nav = nav.withColumn("nav_source", F.lit("recorded"))
    if not list_files(spark, path, *IMAGES).select("path").isEmpty():
        t, n, e = ingest_images(spark, path, geometry)
        traces, nav, bad = traces.unionByName(t), nav.unionByName(n), bad.unionByName(e)
    return traces, nav, bad


def _decode(files: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
    """Frames of each file, decoded once: written as a table, which everything else is derived from.

    `fn(path, content, *columns)` yields Arrow batches of the schema, a bounded number of frames each.
    """
    columns = ("path", "content", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from fn(*(batch.column(c)[row].as_py() for c in columns))

    return written(files.select(*columns).mapInArrow(run, schema))


def _survey(path: Column | str) -> Column:
    return F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"([^/]+)$", 1)


def padded(traces: DataFrame) -> DataFrame:
    """Every survey-side cut or zero-padded to its most common width (smallest on ties)."""
    width = traces.groupBy("survey", "side").agg(F.mode(F.size("samples"), True).alias("_w"))
    j = salted_join(traces, width, ["survey", "side"], "ping")
    return j.select("survey", "side", "ping", fit_width("samples", "_w").alias("samples"))


def _dense_pings(df: DataFrame, order: str) -> DataFrame:
    """Pings numbered 0.. per survey in the order of a logger number."""
    numbers = df.select("survey", order).distinct()
    n = ranked(numbers, ["survey"], [F.asc(order)], "_r").select("survey", order, (F.col("_r") - 1).alias("ping"))
    return df.join(n, ["survey", order])


def two_way_speed(raw: Column) -> Column:
    """Loggers that store the one-way speed are doubled; missing is 1500 m/s."""
    return F.when((raw > 0) & (raw < 1000.0), raw * 2.0).when(raw > 0, raw).otherwise(1500.0)


# ---- .jsf --------------------------------------------------------------------

def ingest_jsf(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files as (path, content) rows, each decoded whole; an archive is better read by register_ranges()'s way."""
    return jsf_tables(_decode(files, D.jsf_frames, D.JSF_SCHEMA))


@register_ranges("jsf", ".jsf")
def jsf_tables(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = frames.withColumn("survey", _survey("path"))
    errors = frames.where("error IS NOT NULL").select("path", "error")
    good = frames.where("error IS NULL")
    t = good.withColumn("side", F.when(F.col("channel") == 0, "port").otherwise("starboard"))
    scale = F.pow(F.lit(2.0), -F.col("weight"))
    t = t.withColumn("samples", F.when(F.col("weight") != 0, F.transform("samples", lambda v: v * scale)).otherwise(F.col("samples")))
    # the last trace of a ping and side wins
    last = t.groupBy("survey", F.col("ping").alias("number"), "side").agg(F.max_by(F.struct(*[c for c in t.columns if c not in ("survey", "ping", "side")]), "offset").alias("r"))
    last = _dense_pings(last, "number").select("survey", "side", "ping", "r.*")
    both = last.groupBy("survey", "ping").agg(
        F.max(F.when(F.col("side") == "port", F.struct("samples"))).alias("p"), F.max(F.when(F.col("side") == "starboard", F.struct("samples"))).alias("s"))
    width = last.groupBy("survey", "side").agg(F.mode(F.size("samples"), True).alias("w"))
    # a ping seen on one side only is zero on the other
    sides = salted_join(both, width, ["survey"], "ping")
    one = F.when(F.col("side") == "port", F.col("p.samples")).otherwise(F.col("s.samples"))
    traces = sides.select("survey", "side", F.col("ping").cast("int").alias("ping"),
                          fit_width(F.coalesce(one, F.array().cast("array<double>")), "w").alias("samples"))
    ref = last.groupBy("survey", "ping").agg(F.max_by(F.struct(*[c for c in last.columns if c not in ("survey", "ping", "samples")]), F.col("side")).alias("r"))
    r = lambda c: F.col(f"r.{c}")
    sv = F.when(r("sound_speed") > 0, r("sound_speed").cast("double")).otherwise(1500.0)
    deg = lambda c: F.when(r("units") == 2, r(c) / F.lit(600000.0))
    n = last.groupBy("survey", "ping").agg(F.max_by(F.size("samples"), "side").alias("n"))
    nav = ref.join(n, ["survey", "ping"]).select(
        "survey", F.col("ping").cast("int").alias("ping"), r("time").cast("double").alias("time"), deg("coord_y").alias("lat"), deg("coord_x").alias("lon"),
        (r("heading_cdeg") / 100.0).alias("heading"), (r("altitude_mm") / 1000.0).alias("altitude"), (r("depth_mm") / 1000.0).alias("sensor_depth"),
        sv.alias("sound_velocity"), slant_range_from_samples("n", r("interval_ns"), sv).alias("slant_range"), F.lit(0.0).alias("speed"), F.lit(0.0).alias("layback"))
    return traces, nav, errors


# ---- .sl2 / .sl3 -------------------------------------------------------------

def ingest_slx(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return slx_tables(_decode(files, D.slx_frames, D.SLX_SCHEMA))


@register_ranges("slx", ".sl2", ".sl3")
def slx_tables(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = frames.withColumn("survey", _survey("path"))
    errors = frames.where("error IS NOT NULL").select("path", "error")
    good = frames.where("error IS NULL")
    has = good.groupBy("survey").agg(F.max((F.col("channel") == 5).cast("int")).alias("composite"), F.min_by("epoch", "offset").alias("base"))
    kept = salted_join(good, has, ["survey"], "offset").where(
        F.col("channel") == F.when(F.col("composite") == 1, 5).otherwise(0))
    kept = ranked(kept, ["survey"], [F.asc("frame_index"), F.asc("offset")], "_r").withColumn("ping", (F.col("_r") - 1).cast("int"))
    half = F.floor(F.size("samples") / 2).cast("int")
    port = F.when(F.col("composite") == 1, F.reverse(F.slice("samples", F.lit(1), half))).otherwise(F.col("samples"))
    stbd = F.when(F.col("composite") == 1, F.slice("samples", half + 1, F.size("samples") - half)).otherwise(F.col("samples"))
    sides = F.array(F.struct(F.lit("port").alias("side"), port.alias("samples")), F.struct(F.lit("starboard").alias("side"), stbd.alias("samples")))
    traces = padded(kept.select("survey", "ping", F.explode(sides).alias("s")).select("survey", "s.side", "ping", "s.samples"))
    pos = G.sl_mercator_to_lonlat("x", "y")
    base = F.when(F.col("fmt") == 3, F.col("base")).otherwise(0)
    nav = kept.select(
        "survey", "ping", (base + F.col("time_ms") / 1000.0).alias("time"), pos["lat"].alias("lat"), pos["lon"].alias("lon"),
        G.heading_or_course("heading", "course").alias("heading"), (F.col("depth_ft").cast("double") * K.FEET_TO_M).alias("altitude"), F.lit(0.0).alias("sensor_depth"),
        F.lit(1500.0).alias("sound_velocity"), (F.col("lower_ft").cast("double") * K.FEET_TO_M).alias("slant_range"),
        (F.col("speed_kn").cast("double") * K.KNOTS_TO_MPS).alias("speed"), F.lit(0.0).alias("layback"))
    return traces, nav, errors


# ---- .dat + B002/B003 beams --------------------------------------------------

@register_format(".dat")
def ingest_son(files: DataFrame, pixel_size_m: float = 0.02, sound_velocity: float = 1500.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    stem = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1)
    kind = files.withColumns({"stem": stem, "suffix": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))})
    dats = kind.where("suffix = '.dat'").select(F.col("stem").alias("rec"), "path", "content")
    beam = F.upper(F.regexp_extract("stem", r"([^/]+)$", 1))
    sons = kind.where("suffix = '.son'").where(beam.isin("B002", "B003")).select("stem", "path", "content", beam.alias("beam"))
    idx = kind.where("suffix = '.idx'").select("stem", F.col("content").alias("idx"))
    pair = sons.join(idx, "stem", "left").withColumn("rec", F.regexp_extract("stem", r"^(.*)/[^/]+$", 1)).join(dats.select("rec"), "rec", "left_semi")

    recs = _decode(pair, D.son_frames, D.SON_SCHEMA, "idx")
    recs = recs.withColumns({"rec": F.regexp_extract("path", r"^(.*)/[^/]+\.[^./]+$", 1),
                             "side": F.when(F.upper(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)) == "B002", "port").otherwise("starboard")})
    head = _decode(dats, D.dat_header, D.DAT_SCHEMA).withColumn("rec", F.regexp_extract("path", r"^(.*)\.[^./]+$", 1))
    sides = pair.groupBy("rec").agg(F.count_distinct("beam").alias("beams"))
    lone = dats.join(sides, "rec", "left").where(F.coalesce("beams", F.lit(0)) < 2).select("path", F.lit("sidescan beam missing").alias("error"))
    errors = (recs.where("error IS NOT NULL").select("path", "error").unionByName(head.where("error IS NOT NULL").select("path", "error")).unionByName(lone))
    good = recs.where("error IS NULL").join(head.where("error IS NULL").select("rec", "unix_time", F.col("path").alias("dat")), "rec")
    good = good.withColumn("survey", _survey("dat"))
    # both beams must have the record: the longer beam is cut to the shorter
    counts = good.groupBy("survey", "side").agg(F.count(F.lit(1)).alias("n")).groupBy("survey").agg(F.min("n").alias("_cut"), F.count(F.lit(1)).alias("sides"))
    good = salted_join(good, counts.where("sides = 2").select("survey", "_cut"), ["survey"], "record").where(F.col("record") < F.col("_cut"))
    good = good.withColumn("ping", F.col("record"))
    traces = padded(good.select("survey", "side", "ping", "samples"))
    pos = G.dat_mercator_to_lonlat("e", "n")
    p = good.where("side = 'port'")
    nav = p.select(
        "survey", "ping", (F.col("unix_time") + F.col("time_ms") / 1000.0).alias("time"), pos["lat"].alias("lat"), pos["lon"].alias("lon"),
        (F.col("heading_ddeg") / 10.0).alias("heading"), (F.col("depth_cm") / 100.0).alias("altitude"), F.lit(0.0).alias("sensor_depth"),
        F.lit(float(sound_velocity)).alias("sound_velocity"), (F.size("samples") * float(pixel_size_m)).alias("slant_range"),
        (F.col("speed_cms") / 100.0).alias("speed"), F.lit(0.0).alias("layback"))
    return traces, nav, errors


# ---- images, decoded frames, mosaics -----------------------------------------

IMAGES = [".png", ".jpg", ".jpeg", ".bmp", ".tif"]
GEOMETRY = ("survey string, combined boolean, lat0 double, lon0 double, heading double, speed double, dt double, altitude double, slant_range double, "
            "start_time double, sensor_depth double")


def image_rows(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source as grey levels: (path, ping, width, pixels).

    A picture is cut into its rows before it leaves the image source, so what
    follows handles a row at a time, however large the picture is.
    """
    i = F.col("image")
    w, c = i["width"], i["nChannels"]
    rows = F.transform(F.sequence(F.lit(0), i["height"] - 1), lambda r: F.substring(i["data"], r * w * c + 1, w * c))
    cut = images.where(i["height"] > 0).select(i["origin"].alias("path"), w.alias("width"), c.alias("channels"), rows.alias("rows"))
    cut = cut.select("path", "width", "channels", F.posexplode("rows").alias("ping", "row"))

    def grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for row, n in zip(b.column(4), b.column(2).to_pylist()):
                m = np.frombuffer(row.as_buffer(), np.uint8).reshape(-1, n).astype(float)
                # blue, green, red order; the usual luma weights, rounded as an 8-bit converter does
                lines.append(m[:, 0] if n == 1 else np.floor((m[:, 2] * 19595 + m[:, 1] * 38470 + m[:, 0] * 7471 + 32768) / 65536))
            at = np.cumsum([0, *map(len, lines)])
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(lines) if lines else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), flat], ["path", "ping", "width", "pixels"])

    return cut.mapInArrow(grey, "path string, ping int, width int, pixels array<double>")


def ingest_images(spark: SparkSession, path: str, geometry: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, nav, errors) of the waterfall pictures under `path`, by the declared geometry (columns of GEOMETRY) of a survey, the file's name.

    A combined picture holds port mirrored in its left half; another one is
    starboard only, with empty port traces.  Undeclared: combined, heading 90,
    2 m/s, 0.1 s a ping, everything else unknown (null).  Pictures that cannot
    be read are errors.
    """
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGES)
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + either + "}").load(path)
    errors = images.where(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0).select(F.col("image.origin").alias("path"), F.lit("unreadable image").alias("error"))
    rows = written(image_rows(images)).withColumn("survey", _survey("path"))
    known = spark.createDataFrame([], GEOMETRY) if geometry is None else geometry
    g = rows.select("survey").distinct().join(known, "survey", "left")
    g = g.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("combined", True), ("heading", 90.0), ("speed", 2.0), ("dt", 0.1))})
    traces = image_traces(salted_join(rows, g.select("survey", "combined"), ["survey"], "ping"), F.col("combined"))
    return traces, declared_nav(rows.select("survey", "ping"), g), errors


def image_traces(rows: DataFrame, combined: Column | bool = True) -> DataFrame:
    """Waterfall rows (survey, ping, pixels) to traces: halves with port un-mirrored, or starboard only."""
    both = (F.lit(combined) if isinstance(combined, bool) else combined) & (F.size("pixels") >= 2)
    half = F.floor(F.size("pixels") / 2).cast("int")
    port = F.when(both, F.reverse(F.slice("pixels", F.lit(1), half))).otherwise(F.array().cast("array<double>"))
    stbd = F.when(both, F.slice("pixels", half + 1, F.size("pixels") - half)).otherwise(F.col("pixels"))
    s = F.array(F.struct(F.lit("port").alias("side"), port.alias("samples")), F.struct(F.lit("starboard").alias("side"), stbd.alias("samples")))
    return rows.select("survey", "ping", F.explode(s).alias("s")).select("survey", "s.side", "ping", "s.samples")


def declared_nav(pings: DataFrame, geometry: DataFrame) -> DataFrame:
    """Nav for imagery from a declared geometry row per survey; no start position means no track."""
    j = salted_join(pings, geometry, ["survey"], "ping")
    track = G.declared_track("ping", "lat0", "lon0", "heading", "speed", "dt")
    known = F.col("lat0").isNotNull() & F.col("lon0").isNotNull()
    return j.select("survey", "ping", (F.col("start_time") + F.col("ping") * F.col("dt")).alias("time"), F.when(known, track["lat"]).alias("lat"),
                    F.when(known, track["lon"]).alias("lon"), "heading", "altitude", "sensor_depth", F.lit(1500.0).alias("sound_velocity"),
                    "slant_range", "speed", F.lit(0.0).alias("layback"),
                    F.when(known, "declared-line").otherwise("none").alias("nav_source"))


def frames_to_nav(frames: DataFrame) -> DataFrame:
    """Decoded logger fields to nav: date parts to epoch (bad date NULL), speeds and ranges normalised."""
    ts = F.try_make_timestamp(years=F.col("year"), months=F.col("month"), days=F.col("day"), hours=F.col("hour"), mins=F.col("minute"),
                              secs=(F.col("second") + F.col("hsec") / 100.0).cast("decimal(16,6)"))
    epoch = F.unix_micros(ts) / F.lit(1e6)
    return frames.select(
        "survey", "ping", epoch.alias("time"), "lat", "lon", "heading", "altitude", "sensor_depth", two_way_speed(F.col("sound_velocity").cast("double")).alias("sound_velocity"),
        F.coalesce(F.array_max("slant_ranges"), F.lit(0.0)).cast("double").alias("slant_range"), (F.col("speed_kn") * K.KNOTS_TO_MPS).alias("speed"), "layback")


def mosaic_rows_to_nav(rows: DataFrame) -> DataFrame:
    """Georeferenced rows (survey, row, n_rows, lat, lon, pixel_size, n_cols) to pseudo-pings.

    Heading is the central difference of the row centres, one-sided at the ends;
    neighbours come from equi joins on row +/- 1, so a long mosaic is not one task.
    """
    near = lambda d, n: rows.select("survey", (F.col("row") + d).alias("row"), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon"))
    j = rows.join(near(1, "b"), ["survey", "row"], "left").join(near(-1, "a"), ["survey", "row"], "left")
    step = F.when(F.col("b_lat").isNotNull() & F.col("a_lat").isNotNull(), 2.0).otherwise(1.0)
    grad = lambda c: (F.coalesce(f"a_{c}", c) - F.coalesce(f"b_{c}", c)) / step
    dlon, dlat = grad("lon") * F.cos(F.radians("lat")), grad("lat")
    return j.select("survey", F.col("row").alias("ping"), F.lit(None).cast("double").alias("time"), "lat", "lon",
                    F.pmod(F.degrees(F.atan2(dlon, dlat)) + 360.0, F.lit(360.0)).alias("heading"), F.lit(None).cast("double").alias("altitude"),
                    F.lit(0.0).alias("sensor_depth"), F.lit(1500.0).alias("sound_velocity"), (F.col("pixel_size") * F.col("n_cols") / 2.0).alias("slant_range"),
                    F.lit(0.0).alias("speed"), F.lit(0.0).alias("layback"))


def pair_sides(traces: DataFrame) -> DataFrame:
    """Port and starboard of each ping side by side; a missing side is zeros of the other side's length.

    A record whose samples are lost (NULL) is a missing side; a ping that lost both stays, without samples.
    """
    side = lambda n: traces.where(F.col("side") == n).select("survey", "ping", F.col("samples").alias(n))
    j = side("port").join(side("starboard"), ["survey", "ping"], "full_outer")
    zero = lambda other: F.transform(other, lambda _: F.lit(0.0))
    return j.select("survey", "ping", *[
        F.coalesce(own, zero(other), F.array().cast("array<double>")).alias(own) for own, other in (("port", "starboard"), ("starboard", "port"))])
