"""Contact reports: JSON, CSV, GeoJSON and KML written by Spark, one folder per survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import band_colour, severity_band

# fixed values: the 24 report columns, in order
CSV_COLUMNS = ["id", "class", "confidence_pct", "severity", "priority", "recommended_action", "lat", "lon",
               "position_accuracy_m", "length_m", "width_m", "height_m", "depth_m", "highlight", "shadow",
               "physics_violation", "side", "ping0", "ping1", "col0", "col1", "detected_at", "review", "survey"]


def flat_contacts(contacts: DataFrame) -> DataFrame:
    """Nested contact rows flattened to the report columns."""
    src = {"class": "cls", "confidence_pct": "confidence", "length_m": "dims.length_m", "width_m": "dims.width_m",
           "height_m": "dims.height_m", "highlight": "physics.highlight", "shadow": "physics.shadow",
           "physics_violation": "physics.physics_violation", "side": "pixel.side", "ping0": "pixel.ping0",
           "ping1": "pixel.ping1", "col0": "pixel.col0", "col1": "pixel.col1"}
    return contacts.select(*[F.col(src.get(c, c)).alias(c) for c in CSV_COLUMNS])


def write_csv(contacts: DataFrame, path: str) -> None:
    flat_contacts(contacts).withColumn("_survey", F.col("survey")).write.mode("overwrite").partitionBy(
        "_survey").csv(path, header=True)


def json_rows(contacts: DataFrame) -> DataFrame:
    return contacts.select("survey", F.to_json(F.struct(*contacts.columns)).alias("value"))


def write_json(contacts: DataFrame, path: str) -> None:
    """JSON lines per survey: the scalable form of the contact document."""
    json_rows(contacts).write.mode("overwrite").partitionBy("survey").text(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def feature(prefix: str = "") -> Column:
    """GeoJSON Feature text of one contact."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(c("lon"), c("lat")).alias("coordinates")).alias("geometry"),
        F.struct(
            c("id").alias("id"), c("cls").alias("class"), c("confidence").alias("confidence_pct"),
            c("severity").alias("severity"), severity_band(c("severity")).alias("severity_band"),
            F.concat(F.lit("#"), band_colour(c("severity"))).alias("marker-color"),
            c("dims")["length_m"].alias("length_m"), c("dims")["width_m"].alias("width_m"),
            c("dims")["height_m"].alias("height_m"), c("depth_m").alias("depth_m"),
            c("physics")["physics_violation"].alias("physics_violation"), c("review").alias("review"),
            F.transform(c("corners"), lambda p: F.array(p["lon"], p["lat"])).alias("footprint"),
        ).alias("properties")), {"ignoreNullFields": "false"})


def write_geojson(contacts: DataFrame, path: str) -> None:
    """One Feature per line (newline-delimited GeoJSON), partitioned by survey."""
    contacts.select("survey", feature().alias("value")).write.mode("overwrite").partitionBy("survey").text(path)


def kml_colour(severity: str, alpha: str) -> Column:
    """aabbggrr text of the band colour."""
    rgb = band_colour(severity)
    return F.concat(F.lit(alpha), F.substring(rgb, 5, 2), F.substring(rgb, 3, 2), F.substring(rgb, 1, 2))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def placemarks() -> Column:
    """Point placemark plus footprint polygon of one contact."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    height = F.coalesce(F.concat(F.col("dims.height_m").cast("string"), F.lit(" m")), F.lit("n/a"))
    about = F.concat(
        F.lit("class: "), text("cls"), F.lit("\nconfidence: "), text("confidence"), F.lit("%\nseverity: "),
        text("severity"), F.lit(" ("), severity_band("severity"), F.lit(")\nsize: "), text("dims.length_m"),
        F.lit(" x "), text("dims.width_m"), F.lit(" m, height "), height, F.lit("\ndepth: "), text("depth_m"),
        F.lit(" m\ndetected: "), text("detected_at"), F.lit("\nphysics: highlight="), text("physics.highlight"),
        F.lit(" shadow="), text("physics.shadow"),
        F.when(F.col("physics.physics_violation"), F.concat(F.lit("\nVIOLATION: "), text("physics.violation_reason")))
        .otherwise(F.lit("")))
    ring = F.transform("corners", lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0.0")))
    ring = F.array_join(F.concat(ring, F.slice(ring, 1, 1)), " ")
    point = F.concat(
        F.lit("<Placemark><name>"), _xml(F.concat_ws(" ", "id", "cls")), F.lit("</name><description>"), _xml(about),
        F.lit("</description><Style><IconStyle><color>"), kml_colour("severity", "ff"),
        F.lit("</color><scale>1.1</scale></IconStyle></Style><Point><coordinates>"),
        F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0.0</coordinates></Point></Placemark>"))
    poly = F.concat(
        F.lit("<Placemark><name>"), _xml(F.col("id")), F.lit(" footprint</name><Style><LineStyle><color>"),
        kml_colour("severity", "ff"), F.lit("</color><width>2</width></LineStyle><PolyStyle><color>"),
        kml_colour("severity", "33"), F.lit("</color></PolyStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    return F.concat(point, F.when(F.size("corners") > 0, poly).otherwise(F.lit("")))


KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_TAIL = "</Document></kml>"


def write_kml(contacts: DataFrame, path: str) -> None:
    """Placemark lines per survey; wrap a survey's lines in KML_HEAD/KML_TAIL to open it as one document."""
    contacts.select("survey", F.regexp_replace(placemarks(), "\n", "&#10;").alias("value")).write.mode(
        "overwrite").partitionBy("survey").text(path)


def decode_contact_json(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Adds `doc`; text that is not JSON keeps its row with `doc` NULL and the text in `raw`."""
    doc = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(F.col(column)).isNull()
    return df.withColumns({"doc": F.when(~bad, doc), "raw": F.when(bad, F.col(column))})
