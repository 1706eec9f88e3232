"""Adapter views: the driver tables read as sonar tables, in both SQL dialects.

One text per view; `{...}` marks the few places where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {
    "long": "BIGINT", "micros": "unix_micros(ts)", "epoch": "(unix_micros(ts) / 1000000.0D)",
    "samples": "SELECT e.vec_id, e.label, p.pos AS col, CAST(p.x AS DOUBLE) AS x FROM embeddings e "
               "LATERAL VIEW posexplode(e.embedding) p AS pos, x",
    "each4": "explode(array(0, 1, 2, 3))",
    "orderday": "date_format(o_orderdate, 'yyyy-MM-dd')",
}
DUCK = {
    "long": "BIGINT", "micros": "epoch_us(ts)", "epoch": "(epoch_us(ts) / 1000000.0::DOUBLE)",
    "samples": "SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS col, "
               "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "each4": "unnest([0, 1, 2, 3])",
    "orderday": "strftime(o_orderdate, '%Y-%m-%d')",
}

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_contacts": (["events"], """
SELECT concat('SN-', CAST(event_id AS STRING)) AS id, concat('S', CAST(user_id % 4 AS STRING)) AS survey,
  CASE event_type WHEN 'click' THEN 'ghost_net' WHEN 'view' THEN 'container' WHEN 'purchase' THEN 'wreck'
    WHEN 'signup' THEN 'tire' ELSE 'unknown_anomaly' END AS cls,
  least(value, CAST(100 AS DOUBLE)) AS confidence,
  CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS severity,
  CAST(13.05 AS DOUBLE) + ((event_id * event_id * 37 + event_id) % 997) * CAST(0.00005 AS DOUBLE) AS lat,
  CAST(80.35 AS DOUBLE) + ((event_id * 61 + user_id * user_id * 17) % 991) * CAST(0.00005 AS DOUBLE) AS lon,
  CASE WHEN event_type = 'error' THEN NULL ELSE value / CAST(40 AS DOUBLE) END AS height_m,
  value / CAST(3 AS DOUBLE) AS depth_m,
  (event_id % 17) * CAST(0.75 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS length_m,
  (user_id % 11) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS width_m,
  value > 20 AS highlight, event_id % 3 <> 0 AS shadow, (event_type = 'purchase' AND value > 60) AS violation,
  CASE WHEN event_id % 2 = 0 THEN 'port' ELSE 'starboard' END AS side,
  CAST(event_id % 2000 AS INT) AS ping0, CAST(event_id % 2000 + 2 + user_id % 9 AS INT) AS ping1,
  CAST(user_id % 400 AS INT) AS col0, CAST(user_id % 400 + 3 + event_id % 13 AS INT) AS col1,
  CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review,
  ts AS detected_at, event_id AS seq
FROM events"""),
    "v_detections": (["lineitem"], """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
    CAST(l_suppkey AS STRING)) AS det_id,
  concat('S', CAST(l_suppkey % 64 AS STRING)) AS survey,
  CASE WHEN l_linestatus = 'O' THEN 'port' ELSE 'starboard' END AS side,
  CAST(l_orderkey % 2000 AS INT) AS ping0, CAST(l_orderkey % 2000 + l_quantity AS INT) AS ping1,
  CAST(l_partkey % 400 AS INT) AS col0, CAST(l_partkey % 400 + 4 * l_linenumber AS INT) AS col1,
  CASE l_returnflag WHEN 'A' THEN 'ghost_net' WHEN 'N' THEN 'container' ELSE 'tire' END AS cls,
  CAST(0.5 AS DOUBLE) + CAST(4 AS DOUBLE) * l_discount AS score,
  CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS brain,
  CAST(l_linenumber AS INT) AS model
FROM lineitem"""),
    "v_truth": (["orders"], """
SELECT concat('T', CAST(o_orderkey AS STRING)) AS truth_id, concat('S', CAST(o_custkey % 64 AS STRING)) AS survey,
  CASE WHEN o_orderkey % 2 = 0 THEN 'port' ELSE 'starboard' END AS side,
  CAST(o_orderkey % 2000 AS INT) AS ping0, CAST(o_orderkey % 2000 + 20 + o_custkey % 20 AS INT) AS ping1,
  CAST(o_custkey % 400 AS INT) AS col0, CAST(o_custkey % 400 + 8 + o_orderkey % 12 AS INT) AS col1,
  CASE o_orderkey % 3 WHEN 0 THEN 'ghost_net' WHEN 1 THEN 'container' ELSE 'tire' END AS cls
FROM orders"""),
    "v_reviews": (["orders"], """
SELECT concat('SN-', CAST(o_orderkey % 5000 AS STRING)) AS contact_id,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  {orderday} AS reviewed_at, o_orderkey AS seq, concat('a', CAST(o_custkey % 7 AS STRING)) AS actor
FROM orders"""),
    "v_layers": (["nation", "region"], """
SELECT concat('L', CAST(r.r_regionkey AS STRING)) AS layer, CAST(n.n_nationkey AS INT) AS feature, n.n_name AS name,
  CASE r.r_regionkey WHEN 0 THEN 'mpa' WHEN 1 THEN 'turtle_zone' WHEN 2 THEN 'shipping_lane' ELSE NULL END AS kind,
  CAST(1 AS DOUBLE) - r.r_regionkey * CAST(0.125 AS DOUBLE) AS weight,
  CAST(13.045 AS DOUBLE) + (n.n_nationkey % 5) * CAST(0.012 AS DOUBLE) AS lat0,
  CAST(80.345 AS DOUBLE) + floor(n.n_nationkey / 5) * CAST(0.0115 AS DOUBLE) AS lon0,
  CAST(0.002 AS DOUBLE) + (n.n_nationkey % 3) * CAST(0.0005 AS DOUBLE) AS size
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    # closed square ring per feature, one row per segment
    "v_segments": (["v_layers"], """
SELECT layer, feature, name, kind, weight, s AS seq,
  lon0 + CASE WHEN s IN (1, 2) THEN size ELSE 0 END AS x0, lat0 + CASE WHEN s IN (2, 3) THEN size ELSE 0 END AS y0,
  lon0 + CASE WHEN s IN (0, 1) THEN size ELSE 0 END AS x1, lat0 + CASE WHEN s IN (1, 2) THEN size ELSE 0 END AS y1
FROM (SELECT *, {each4} AS s FROM v_layers) q"""),
    "v_samples": (["embeddings"], """
SELECT concat('S', CAST(vec_id % 5 AS STRING)) AS survey,
  CASE WHEN floor(vec_id / 5) % 2 = 0 THEN 'port' ELSE 'starboard' END AS side,
  CAST(floor(vec_id / 10) AS INT) AS ping, CAST(col AS INT) AS col,
  CASE WHEN col < 9 + vec_id % 4 THEN 4 * (1 + x)
       ELSE (100 * (1 + 2 * x)) * (1.5 - col / CAST(128 AS DOUBLE)) END AS v
FROM ({samples}) q"""),
    "v_nav": (["v_samples"], """
SELECT survey, ping, CAST(1700000000 AS DOUBLE) + ping * CAST(0.5 AS DOUBLE) AS time,
  CAST(13.05 AS DOUBLE) + ping * CAST(0.00001 AS DOUBLE) AS lat,
  CAST(80.35 AS DOUBLE) + (ping % 7) * CAST(0.0000025 AS DOUBLE) AS lon,
  CAST(ping % 5 AS DOUBLE) AS heading,
  CASE WHEN ping % 11 = 10 THEN NULL ELSE CAST(8 AS DOUBLE) + (ping % 7) * CAST(0.25 AS DOUBLE) END AS altitude,
  CAST(3 AS DOUBLE) AS sensor_depth, CAST(1500 AS DOUBLE) AS sound_velocity, CAST(50 AS DOUBLE) AS slant_range,
  CAST(2 AS DOUBLE) AS speed, CASE WHEN ping % 3 = 0 THEN NULL ELSE CAST(10 AS DOUBLE) END AS layback
FROM (SELECT DISTINCT survey, ping FROM v_samples) p"""),
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _order(needed: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name):
        for dep in VIEWS[name][0]:
            if dep in VIEWS:
                visit(dep)
        if name not in out:
            out.append(name)

    for n in needed:
        visit(n)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, parts: int) -> DataFrame:
    """The rows in `parts` partitions, unless the scan has as many tasks that share them well: their shuffle is as large as the table."""
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= parts:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]    # footers only
        if rows and max(rows) <= 2 * sum(rows) / parts:
            return df
    return df.repartition(parts)


def view(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """The adapter view as a lazy DataFrame (column pruning reaches the scan), its tables in `parts` partitions or so if given."""
    deps, text = VIEWS[name]
    table = lambda d: read(spark, sf_dir, d) if parts is None else spread(read(spark, sf_dir, d), parts)
    frames = {d: view(spark, sf_dir, d, parts) if d in VIEWS else table(d) for d in deps}
    text = text.format(**SPARK)
    for d in deps:
        text = text.replace(f"FROM {d}", f"FROM {{{d}}}").replace(f"JOIN {d}", f"JOIN {{{d}}}")
    return spark.sql(text, **frames)


def duck(needed: list[str], body: str) -> str:
    """WITH the adapter views a query needs, in DuckDB's dialect."""
    ctes = [f"{n} AS ({VIEWS[n][1].format(**DUCK)})" for n in _order(needed)]
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
