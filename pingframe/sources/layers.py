"""Sensitive-area layers (GeoJSON) and mission profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])),
    T.StructField("geometry", _GEOMETRY)])
_DOC = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_FEATURE)),
                     T.StructField("properties", _FEATURE["properties"].dataType), T.StructField("geometry", _GEOMETRY)])


def read_layers(spark: SparkSession, path: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Segments of every .geojson under `path`; the file stem names the layer and picks its weight (default 1)."""
    raw = (spark.read.option("pathGlobFilter", "*.geojson").option("recursiveFileLookup", "true")
           .option("wholetext", "true").text(path).withColumn("_file", F.input_file_name()))
    doc = F.from_json("value", _DOC)
    stem = F.regexp_extract("_file", r"([^/]+)\.geojson$", 1)
    features = raw.select(stem.alias("layer"), doc.alias("d")).select(
        "layer", F.posexplode(F.when(F.col("d.features").isNotNull(), F.col("d.features")).when(
            F.col("d.type") == "Feature", F.array(F.struct(F.col("d.type").alias("type"), F.col("d.properties").alias("properties"),
                                                           F.col("d.geometry").alias("geometry"))))).alias("feature", "f"))
    t, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line = F.from_json(text, "array<array<double>>")
    rings = F.from_json(text, "array<array<array<double>>>")
    polys = F.from_json(text, "array<array<array<array<double>>>>")
    tag = lambda rs: F.transform(rs, lambda r, i: F.struct((i == 0).alias("outer"), r.alias("pts")))
    all_rings = (F.when(t == "Polygon", tag(rings)).when(t == "MultiPolygon", F.flatten(F.transform(polys, tag)))
                 .when(t == "LineString", F.array(F.struct(F.lit(False).alias("outer"), line.alias("pts"))))
                 .when(t == "MultiLineString", F.transform(rings, lambda r: F.struct(F.lit(False).alias("outer"), r.alias("pts")))))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("layer") == name, F.lit(float(w))).otherwise(weight)
    segs = (features.withColumn("r", F.explode(all_rings))
            .withColumn("r", F.when(F.size("r.pts") == 1, F.struct(F.col("r.outer").alias("outer"), F.concat("r.pts", "r.pts").alias("pts")))
                        .otherwise(F.col("r")))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.size("r.pts") - 2)))
            .where(F.size("r.pts") >= 2))
    at = lambda k, d: F.col("r.pts")[F.col("i") + k][d]
    names = raw.select(stem.alias("layer")).distinct()
    # layer order is file-name order: position in the sorted array of names (one per file of a config folder)
    order = names.agg(F.array_sort(F.collect_set("layer")).alias("_names")).withColumn("_k", F.lit(1))
    out = segs.select("layer", "feature", F.coalesce("f.properties.name", "layer").alias("name"),
                      F.col("f.properties.kind").alias("kind"), weight.alias("weight"), t.isin("Polygon", "MultiPolygon").alias("is_area"),
                      F.col("r.outer").alias("outer"), at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"), at(1, 1).alias("y1"))
    return (out.withColumn("_k", F.lit(1)).join(order, "_k")
            .withColumn("ord", F.array_position("_names", F.col("layer")).cast("int")).drop("_k", "_names"))


def mission_hazards(spark: SparkSession, overrides: DataFrame) -> DataFrame:
    """(mission, cls, hazard): every mission's full table, overrides over the defaults."""
    default = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in K.HAZARD]), F.array(*[F.lit(v) for v in K.HAZARD.values()])))
    base = overrides.select("mission").distinct().select("mission", default.alias("cls", "_default"))
    extra = overrides.select("mission", "cls", F.col("hazard").alias("_over"))
    return (base.join(extra, ["mission", "cls"], "full_outer")
            .select("mission", "cls", F.coalesce("_over", "_default").alias("hazard")))


def read_missions(spark: SparkSession, path: str) -> DataFrame:
    """Mission profiles from `key: value` text files with an indented `hazard_overrides:` block.

    One row per (mission, cls, hazard) override plus the profile columns.
    """
    lines = (spark.read.option("pathGlobFilter", "*.yaml").text(path, lineSep="\n")
             .select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.yaml$", 1).alias("mission"),
                     F.regexp_replace("value", r"\s+#.*$", "").alias("line")))
    entry = F.regexp_extract("line", r"^\s+([a-z_]+):\s*([0-9.]+)\s*$", 1)
    over = lines.where(entry.isin(*K.REPORTABLE)).select(
        "mission", entry.alias("cls"), F.regexp_extract("line", r":\s*([0-9.]+)", 1).cast("double").alias("hazard"))
    conf = lines.where(F.col("line").startswith("detector_conf:")).groupBy("mission").agg(
        F.max(F.regexp_extract("line", r":\s*([0-9.]+)", 1).try_cast("double")).alias("detector_conf"))
    return over.join(conf, "mission", "left")
