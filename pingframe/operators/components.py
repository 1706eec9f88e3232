"""Connected components over an edge table, and 2-D blobs from row runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scale import salted_join


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Label every node with the smallest node of its component.

    Each round points every node of the (contracted) graph at the neighbour with
    the smallest hash of the round, shortens the pointers, and re-labels the
    edges.  The hash order is new in every round, so long ordered chains shrink
    geometrically too; edges inside a component vanish and copies fold.  Minimums
    combine map-side, so a hub of any degree costs one row per task.
    """
    e = cut_lineage(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
                    .where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")),
                                          F.struct(F.col("a").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.col("b").alias("y")))).alias("s"))
        order = F.struct(F.xxhash64(F.lit(len(maps)), F.col("s.y")).alias("h"), F.col("s.y").alias("y"))
        parent = both.groupBy(F.col("s.x").alias("x")).agg(F.min(order).alias("m")).select("x", F.col("m.y").alias("p"))
        for _ in range(2):                                   # pointer jumping
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
        parent = cut_lineage(parent)
        maps.append(parent)
        pa = parent.select(F.col("x").alias("a"), F.col("p").alias("na"))
        pb = parent.select(F.col("x").alias("b"), F.col("p").alias("nb"))
        e = cut_lineage(e.join(pa, "a").join(pb, "b").where("na <> nb")
                        .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    base = nodes.select(node)
    if not maps:
        return base.withColumn("label", F.col(node))
    label = maps[-1].select("x", "p")
    for m in reversed(maps[:-1]):
        up = label.select(F.col("x").alias("p"), F.col("p").alias("root"))
        label = m.select("x", "p").join(up, "p", "left").select("x", F.coalesce("root", "p").alias("p"))
    comp = cut_lineage(base.join(label.select(F.col("x").alias(node), F.col("p").alias("_l")), node, "left")
                       .select(node, F.coalesce("_l", node).alias("_root")))
    least = comp.groupBy("_root").agg(F.min(node).alias("label"))
    return salted_join(comp, least, ["_root"], node).select(node, "label")


def runs_of(flags: Column) -> Column:
    """Maximal runs of TRUE in a boolean array as array<struct(c0, c1)>.

    A run starts where a TRUE has no TRUE before it and ends where none follows;
    starts and ends pair up by position.
    """
    n = F.size(flags)
    at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))  # noqa: E731 - outside counts as FALSE
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(idx, lambda i: at(i) & ~at(i - 1))
    ends = F.filter(idx, lambda i: at(i) & ~at(i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("c0"), e.alias("c1")))


def row_runs(rows: DataFrame, keys: Sequence[str], flags: str, ping: str = "ping") -> DataFrame:
    """Exploded runs with an id that sorts by (keys, ping, column)."""
    r = rows.select(*keys, ping, F.explode(runs_of(F.col(flags))).alias("r"))
    return r.select(*keys, ping, F.col("r.c0").alias("c0"), F.col("r.c1").alias("c1"),
                    F.concat_ws("|", *keys, F.lpad(F.col(ping).cast("string"), 12, "0"),
                                F.lpad(F.col("r.c0").cast("string"), 9, "0")).alias("run_id"))


def blobs(runs: DataFrame, keys: Sequence[str], ping: str = "ping") -> DataFrame:
    """4-connected components of runs: adds `blob` (its first run) to every run.

    Runs of neighbouring pings touch when their columns overlap; the join is on
    (keys, ping), so it spreads over all pings however long one survey is.
    """
    below = runs.select(*keys, (F.col(ping) - 1).alias(ping), F.col("c0").alias("d0"), F.col("c1").alias("d1"),
                        F.col("run_id").alias("dst"))
    touch = (runs.join(below, [*keys, ping]).where((F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1")))
             .select(F.col("run_id").alias("src"), "dst"))
    comp = connected_components(runs.select("run_id"), touch, "run_id")
    return runs.join(comp, "run_id").withColumnRenamed("label", "blob")


def islands(df: DataFrame, keys: Sequence[str], pos: str, max_gap: int) -> DataFrame:
    """Islands of positions whose gaps are at most `max_gap` missing positions: adds `island` (start position)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    fresh = F.coalesce(F.col(pos) - F.lag(pos).over(w) > max_gap + 1, F.lit(True))
    start = F.last(F.when(fresh, F.col(pos)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", start)
