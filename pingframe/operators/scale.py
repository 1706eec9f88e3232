"""Building blocks that keep hot groups out of single tasks.

Every helper first looks at the size of the largest group (one map-side
combined count).  Small groups take the plain Spark operator; groups beyond the
limit take an exact route whose tasks stay bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, written

GROUP_ROWS = 1_000_000
SMALL_ROWS = 50_000          # rows of a table that may be broadcast


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: one partial-aggregated count, one row to the driver."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return int(counts.agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
           max_group: int = GROUP_ROWS) -> DataFrame:
    """`row_number` per key group (or over everything when there are no keys).

    `order` must be a total order.  Beyond `max_group` rows the table is range
    partitioned on keys and order, so one group spans many tasks; each row's
    rank is its place in its range plus the rows of the same group before it.
    """
    keys = list(keys)
    if largest_group(df, keys) <= max_group:
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(part.orderBy(*order)))
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = written(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                     .withColumn("_range", F.spark_partition_id()))
    # one row per (range, key): at most `n` rows per key, so this window is small
    before = (ranged.groupBy("_range", *keys).count()
              .withColumn("_before", F.coalesce(F.sum("count").over(
                  Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("count"))
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return (ranged.withColumn("_local", local)
            .join(before, ["_range", *keys])
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("int"))
            .drop("_range", "_local", "_before"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str],
                 max_group: int = GROUP_ROWS) -> DataFrame:
    """Inclusive running sums per key in a total order; same two-level scheme as `ranked`."""
    keys = list(keys)
    if largest_group(df, keys) <= max_group:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumns({o: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for o, c in sums.items()})
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = written(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                     .withColumn("_range", F.spark_partition_id()))
    w_range = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = totals.select("_range", *keys, *[
        F.coalesce(F.sum(f"_t_{o}").over(w_range), F.lit(0)).alias(f"_b_{o}") for o in sums])
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_l_{o}": F.sum(c).over(w) for o, c in sums.items()})
    out = local.join(before, ["_range", *keys])
    return (out.withColumns({o: F.col(f"_b_{o}") + F.col(f"_l_{o}") for o in sums})
            .drop("_range", *[f"_b_{o}" for o in sums], *[f"_l_{o}" for o in sums]))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      max_group: int = GROUP_ROWS, group_rows: int | None = None) -> DataFrame:
    """Linear-interpolated percentiles per group, NULLs skipped: keys + one column per entry of `probs`.

    Groups of at most `max_group` rows go to Spark's `percentile`, which holds a
    group's values in one task; beyond, order statistics are found by
    `order_statistics` and interpolated as `percentile` does, so both give the
    same bits.  `group_rows` may pass a known bound on the group size (e.g. pings
    x samples per bin from a narrow table) so that the size check does not run
    the input.  A group without values has a row of NULLs.
    """
    keys = list(keys)
    rows = largest_group(df, keys) if group_rows is None else group_rows
    if rows <= max_group:
        aggs = [F.percentile(value, F.lit(p)).alias(o) for o, p in probs.items()]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    group = keys or ["_all"]
    base = df.select(*keys, value) if keys else df.select(F.lit(0).alias("_all"), value)
    sizes = cut_lineage(base.groupBy(*group).agg(F.count(value).alias("_n")))
    at = F.array(*[F.struct(F.lit(o).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("pos")) for o, p in probs.items()])
    wanted = sizes.where("_n > 0").select(*group, F.explode(at).alias("w")).select(*group, "w.name", "w.pos", F.floor("w.pos").alias("low"), F.ceil("w.pos").alias("high"))
    ranks = wanted.select(*group, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = order_statistics(base, group, value, ranks)
    one = lambda r: found.select(*group, F.col("rank").alias(r), F.col("value").alias(f"_{r}"))
    both = wanted.join(one("low"), [*group, "low"]).join(one("high"), [*group, "high"])
    at_pos = (F.when((F.col("low") == F.col("high")) | (F.col("_low") == F.col("_high")), F.col("_low"))
              .otherwise((F.col("high") - F.col("pos")) * F.col("_low") + (F.col("pos") - F.col("low")) * F.col("_high")))
    named = both.groupBy(*group).agg(*[F.max(F.when(F.col("name") == o, at_pos)).alias(o) for o in probs])
    out = sizes.select(*group).join(named, group, "left")
    return out if keys else out.agg(*[F.max(o).alias(o) for o in probs])      # one row, of an empty table too


#: Bits of a number that one round of `order_statistics` decides.
RADIX = 16


@F.arrow_udf(T.LongType())
def ordered_bits(values: pa.Array) -> pa.Array:
    """A double's 64 bits as an integer of the same order; -0.0 counts as 0.0, and any NaN as the largest number."""
    v = values.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.arrow_udf(T.DoubleType())
def from_ordered_bits(bits: pa.Array) -> pa.Array:
    b = bits.to_numpy(zero_copy_only=False)
    return pa.array(np.where(b < 0, b ^ np.int64(2**63 - 1), b).view(np.float64))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the values of the wanted ranks (keys, rank from 0, once each) among each group's non-null values in ascending order.

    A radix search for all ranks of all groups at once.  The numbers are written
    once, as order-preserving bits; each of four rounds counts, map-side first,
    the next 16 bits of the numbers that share their bits so far with a wanted
    one, at most 65,536 counts for a group and a rank, and picks the counts that
    the ranks fall into.  No task sees a group, nothing is estimated, and copies
    of a value are one count.
    """
    keys = list(keys)
    data = written(df.where(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value).cast("double")).alias("_bits")))
    state = cut_lineage(ranks.select(*keys, "rank", F.lit(0).cast("long").alias("_head"), F.lit(0).cast("long").alias("_below")))
    few = state.count() <= SMALL_ROWS                     # a checkpoint's size is not known to Spark, which would shuffle every number
    for shift in range(64 - RADIX, -1, -RADIX):
        rows = data.withColumn("_head", F.shiftright("_bits", shift + RADIX) if shift + RADIX < 64 else F.lit(0).cast("long"))
        heads = state.select(*keys, "_head").distinct()
        rows = rows.join(F.broadcast(heads), [*keys, "_head"]) if few else salted_join(rows, heads, [*keys, "_head"], "_bits")
        counts = rows.groupBy(*keys, "_head", F.shiftright("_bits", shift).alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
        before = F.sum("_c").over(Window.partitionBy(*keys, "_head").orderBy("_cell")) - F.col("_c")
        place = F.col("rank") - F.col("_below") - F.col("_before")
        state = cut_lineage(state.join(counts.withColumn("_before", before), [*keys, "_head"]).where((place >= 0) & (place < F.col("_c")))
                            .select(*keys, "rank", F.col("_cell").alias("_head"), (F.col("_below") + F.col("_before")).alias("_below")))
    return state.select(*keys, "rank", from_ordered_bits("_head").alias("value"))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salt_on: str, salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Join a table with hot keys to a one-row-per-key table.

    The small side is repeated once per salt, so a key holding a third of `big`
    is spread over `salts` tasks.  AQE still turns this into a broadcast join
    when the measured size of `small` is under its threshold.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by `order`: `max_by`, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def neighbours_in_order(df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = 4096) -> DataFrame:
    """Nearest non-null `value` at or before / at or after every row, with its position.

    Adds `_px,_pv` (previous) and `_nx,_nv` (next).  Blocks of `block` positions
    are scanned independently; only one summary row per block meets the others.
    """
    keys = list(keys)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("v")))
    rows = df.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_pt", point)
    summary = rows.groupBy(*keys, "_blk").agg(
        F.min_by("_pt", F.when(F.col("_pt").isNotNull(), F.col(order))).alias("_first"),
        F.max_by("_pt", F.when(F.col("_pt").isNotNull(), F.col(order))).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_blk")
    carry = summary.select(
        *keys, "_blk",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_prev"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_in_next"))
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    local = rows.withColumns({
        "_lp": F.last("_pt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_ln": F.first("_pt", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    out = local.join(carry, [*keys, "_blk"])
    prev, nxt = F.coalesce("_lp", "_in_prev"), F.coalesce("_ln", "_in_next")
    return (out.withColumns({"_px": prev["x"], "_pv": prev["v"], "_nx": nxt["x"], "_nv": nxt["v"]})
            .drop("_blk", "_pt", "_lp", "_ln", "_in_prev", "_in_next"))


def interpolate_gaps(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str,
                     block: int = 4096) -> DataFrame:
    """Linear fill of NULLs by position, flat beyond the ends."""
    near = neighbours_in_order(df, keys, order, value, block)
    span = F.col("_nx") - F.col("_px")
    frac = (F.col(order) - F.col("_px")) / F.nullif(span, F.lit(0).cast("double"))
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(F.col("_px").isNull(), F.col("_nv")).when(F.col("_nx").isNull(), F.col("_pv"))
              .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * frac))
    return near.withColumn(name, filled).drop("_px", "_pv", "_nx", "_nv")


def mirrored_blocks(df: DataFrame, keys: Sequence[str], order: str, n_rows: str, halo: int, block: int) -> DataFrame:
    """Rows copied into blocks of `block` positions with `halo` rows around, mirrored at both ends.

    Adds `_q` (virtual position, may be <0 or >= n), `_blk` and `_own`.  Position
    -1 shows row 0 and position n shows row n-1, as image filters reflect edges.
    """
    p, n = F.col(order).cast("long"), F.col(n_rows).cast("long")
    turns = F.ceil(F.lit(halo) / (2.0 * n)).cast("long") + 1
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(p + 2 * n * k, -1 - p + 2 * n * k)))
    places = F.filter(places, lambda q: (q >= -halo) & (q < n + halo))
    virtual = df.withColumn("_q", F.explode(places))
    last = F.floor((n - 1) / block)
    lo = F.greatest(F.ceil((F.col("_q") - halo - block + 1) / block), F.lit(0))
    hi = F.least(F.floor((F.col("_q") + halo) / block), last)
    return (virtual.withColumn("_blk", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
            .withColumn("_own", (F.floor(F.col("_q") / block) == F.col("_blk")) & (F.col("_q") >= 0) & (F.col("_q") < n)))


def framed(df: DataFrame, keys: Sequence[str], order: str, n_rows: str, before: int, after: int,
           make: dict, block: int = 2048) -> DataFrame:
    """Sliding-frame columns over mirrored edges; `make` maps name -> fn(window) -> Column."""
    halo = max(before, after)
    w = Window.partitionBy(*keys, "_blk").orderBy("_q").rowsBetween(-before, after)
    return (mirrored_blocks(df, keys, order, n_rows, halo, block)
            .withColumns({name: fn(w) for name, fn in make.items()})
            .where("_own").drop("_q", "_blk", "_own"))
