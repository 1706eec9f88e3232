"""Contiguous shards of nearly equal bytes from global prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stored

#: Bytes that a record adds to its text.
OVERHEAD = 16
#: Quantile ranges of the key; each is divided evenly into as many steps as keep a step near STEP_BYTES.
COARSE = 64
STEP_BYTES = 32 << 20


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead of a record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def number_of(key: Column, cuts: list[int], at: int = 0) -> Column:
    """How many of the ascending cuts are at most `key`, by halving."""
    if not cuts:
        return F.lit(at)
    mid = len(cuts) // 2
    return F.when(key < F.lit(cuts[mid]), number_of(key, cuts[:mid], at)).otherwise(number_of(key, cuts[mid + 1:], at + mid + 1))


class _Ranges:
    """Key ranges in global order, as columns (range, step, later, piece) of a row's key and hash.

    Quantiles of the key give the ranges, even steps divide them.  A key that
    covers several quantiles is hot: it starts its range, precedes the range's
    other keys, and is dealt into pieces of its hash space.
    """

    def __init__(self, place: DataFrame, step_bytes: int):
        whole = place.agg(F.sum("s").alias("bytes"), F.percentile_approx("k", [i / COARSE for i in range(COARSE)], 100 * COARSE).alias("cuts"),
                          F.max("k").alias("top")).first()
        self.total, cuts, top = whole["bytes"] or 0, whole["cuts"] or [], whole["top"]
        self.steps = max(1, -(-self.total // (COARSE * step_bytes)))
        self.starts = sorted(set(cuts))
        self.ends = [*self.starts[1:], top + 1] if self.starts else []
        self.hot = {c: cuts.count(c) for c in self.starts if cuts.count(c) > 1}

    def of(self, k: Column, h: Column) -> list[Column]:
        number = F.when(k.isNull(), F.lit(0)).otherwise(number_of(k, self.starts)).cast("int")
        lo, hi = (F.get(F.array(*[F.lit(x).cast("long") for x in [0, *xs]]), number).cast("double") for xs in (self.starts, self.ends))
        step = F.floor((k.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * F.lit(self.steps))
        step = F.when(number == 0, 0).otherwise(F.least(step, F.lit(self.steps - 1))).cast("int")
        spread = (h.cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
        later, piece = F.lit(1), F.lit(0)
        for c, n in self.hot.items():
            later = F.when(k == F.lit(c), F.lit(0)).otherwise(later)
            piece = F.when(k == F.lit(c), F.floor(spread * (n * self.steps)).cast("int")).otherwise(piece)
        return [number, step, later, piece]


def balanced_shards(docs: DataFrame, shards: int, size: Column | None = None, key: str = "doc_id", tie: Column | None = None,
                    step_bytes: int = STEP_BYTES) -> DataFrame:
    """Add `shard` (int, from 0) and `slot` (long, from 0 without gaps in each shard).

    Shards are contiguous in the order of `key` (an integer column) and near
    equal in size: the table is dealt into key ranges, the ranges' totals give
    each range its offset in the global prefix sum, a running sum inside the
    range goes on from there, and the sum is cut at equal targets.  A row goes
    where its middle byte falls, so a cut is off its target by half a row at
    most.  `size` and `tie` default to the bytes and a hash of the column `text`.

    Null keys come first; equal keys follow `tie` (a long), and rows equal in
    both are interchangeable.  A key that holds many rows fills many ranges.  An
    empty table gives an empty table; columns named `shard` and `slot` are
    replaced, all others stay.  Two narrow jobs place the cuts; the rows
    themselves move once.
    """
    docs = docs.drop("shard", "slot")
    size = record_bytes(F.col("text")) if size is None else size
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if tie is None else tie
    place = stored(docs.select(F.col(key).cast("long").alias("k"), tie.alias("h"), size.alias("s")), "shard-places")
    cut = _Ranges(place, step_bytes)
    names = ["n", "d", "l", "p"]
    placed = place.withColumns(dict(zip(names, cut.of(F.col("k"), F.col("h")))))
    before = Window.orderBy(*names)          # one row a range: total bytes / STEP_BYTES + COARSE of them, however many rows there are
    offsets = stored(placed.groupBy(*names).agg(F.sum("s").alias("bytes"), F.count(F.lit(1)).alias("rows")).select(
        *names, (F.sum("bytes").over(before) - F.col("bytes")).alias("b"), (F.sum("rows").over(before) - F.col("rows")).alias("r")), "shard-offsets")

    def cuts(df: DataFrame, ranges: list[str], k: str, h: str, s: str, b: str, r: str) -> tuple[Column, Column]:
        inside = Window.partitionBy(*ranges).orderBy(F.col(k).asc_nulls_first(), F.col(h), F.col(s)).rowsBetween(Window.unboundedPreceding, 0)
        middle = (F.col(b) + F.sum(s).over(inside)).cast("decimal(38,0)") * 2 - F.col(s)
        shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(cut.total, 1)).cast("decimal(20,0)"))).cast("int")
        return shard, F.col(r) + F.count(F.lit(1)).over(inside) - 1

    shard, row = cuts(placed, names, "k", "h", "s", "b", "r")
    firsts = dict(placed.join(offsets, names).select(shard.alias("shard"), row.alias("row")).groupBy("shard").agg(F.min("row")).collect())  # a row a shard

    own = spare(docs, "_key", "_tie", "_size", "_n", "_d", "_l", "_p", "_b", "_r")
    k, h, s, *ranges, b, r = own
    moved = docs.withColumns({k: F.col(key).cast("long"), h: tie, s: size})
    moved = moved.withColumns(dict(zip(ranges, cut.of(F.col(k), F.col(h)))))
    moved = moved.join(offsets.toDF(*ranges, b, r), ranges)
    shard, row = cuts(moved, ranges, k, h, s, b, r)
    first = F.get(F.array(*[F.lit(firsts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard"))
    return moved.withColumns({"shard": shard, "slot": row}).withColumn("slot", F.col("slot") - first).drop(*own)
