"""Mixing sources to target weights: whole documents, budgets met by subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stored, word_count

#: Weights of the sources in code-point order, repeated; the most copies of a source or document; seed of the choice.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
#: Words that the dynamic programme may fit at the end of a source's budget.
FIT_WORDS = 1 << 18
#: The hash space of the documents of one length is cut into 2 ** PIECE_BITS pieces.
PIECE_BITS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add `target` to a table of one row per source (source, source_size).

    Targets share the total by weight; one above `most` times its source stops
    there and the excess goes to the others by weight, until none is above.  In
    closed form: target = min(cap, level * weight), and the level follows from
    the sources in the order of cap / weight, each capped if the level that
    fits the rest is above its own.  The table has a row per source, so its
    windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    t = sizes.withColumns({"w": w, "cap": F.col("source_size").cast("double") * most})
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    up_to = ratio.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    t = t.withColumns({"total": F.sum("source_size").over(everything).cast("double"), "c": F.sum("cap").over(up_to) - F.col("cap"),
                       "rest": F.sum("w").over(everything) - F.sum("w").over(up_to) + F.col("w")})
    level = (F.col("total") - F.col("c")) / F.col("rest")            # if all before this one are capped and this one is not
    t = t.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    t = t.withColumn("level", F.max("level").over(everything))          # later sources would count uncapped ones as capped: a lower level
    return t.select(*sizes.columns, F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to `budget` from below as subset sums allow.

    An even share of every length takes the bulk, then the longest that fit go
    in until the rest is within `fit_words`; the rest is filled by a bounded
    knapsack: a bit set of reachable sums, copies of a length in powers of two,
    walked back from the largest sum reached.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0:
        return taken
    order = np.argsort(-lengths, kind="stable")
    # leave room for the fit, so that it has choices; lengths above the room are placed by the even share and the greedy pass
    share = max(0.0, (budget - fit_words // 2) / total)
    taken += np.floor(counts * share).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in order:
        n = min(int(counts[i] - taken[i]), (rest - fit_words) // int(lengths[i])) if rest > fit_words and lengths[i] else 0
        if n > 0:
            taken[i] += n
            rest -= n * int(lengths[i])
    rest = min(rest, total)
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in np.argsort(lengths, kind="stable"):
        length = int(lengths[i])
        free = min(int(counts[i] - taken[i]), rest // length) if length else 0
        n = 1
        while free > 0 and not reach >> rest & 1:
            n = min(n, free)
            wider = reach | (reach << (n * length)) & mask
            if wider != reach:
                steps.append((i, n, reach))
                reach = wider
            free -= n
            n *= 2
    at = reach.bit_length() - 1
    for i, n, had in reversed(steps):
        if not had >> at & 1:
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def mix_plan(lengths: DataFrame, targets: DataFrame, most: int = MOST_COPIES, fit_words: int = FIT_WORDS) -> DataFrame:
    """(mark, size, times, extra, source_size, target): each of the n documents goes in `times` times, and `extra` of them once more.

    Whole rounds of a source come first, then the subset-sum fit of what is left
    of its target.  A group holds one row per length of its source.
    """
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n, have, target = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = min(most, int(target // have)) if have else 0
        extra = np.zeros(len(size), np.int64) if times >= most or not have else fit_counts(size, n, int(round(target - times * have)), fit_words)
        return pdf[["mark", "size", "source_size", "target"]].assign(times=times, extra=extra)

    return lengths.join(targets, "mark").groupBy("mark").applyInPandas(
        plan, "mark string, size long, times int, extra long, source_size long, target double")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", size: Column | None = None, tie: Column | None = None,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, fit_words: int = FIT_WORDS) -> DataFrame:
    """Add `size`, `source_size` (long), `target` (double, of the source) and `times` (int, copies of the document in the mix).

    Documents of a length are interchangeable for the budget; which of them get
    the extra copy is decided by a seeded hash of `key` and `tie`: the hash space
    is cut into pieces, whole pieces are in or out by their running count, and
    only the piece in which the count ends has to be ranked.  So a length or
    source of any number of rows is spread, and reruns agree.  `size` and `tie`
    default to the words and a hash of the column `text`.

    A null text has no words: it is in each whole round of its source and adds
    nothing.  A null source is a source, the last.  Rows equal in key and tie
    are interchangeable.  An empty table gives an empty table; columns named
    like the results are replaced, all others stay.
    """
    docs = docs.drop("size", "source_size", "target", "times")
    size = word_count(F.col("text")) if size is None else size
    tie = F.xxhash64("text") if tie is None else tie
    own = spare(docs, "_source", "_size", "_piece", "_hash", "_rank", "_n", "_quota", "_base")
    s, z, p, h, rank, n, quota, base = own
    marked = docs.withColumns({s: F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), z: size, h: F.xxhash64(F.lit(seed), F.col(key), tie)})
    marked = marked.withColumn(p, F.shiftrightunsigned(h, 64 - PIECE_BITS).cast("int"))
    counts = stored(marked.groupBy(F.col(s).alias("mark"), F.col(z).alias("size"), F.col(p).alias("piece")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    lengths = counts.groupBy("mark", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("mark").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = F.when(F.col("mark") == "", F.lit(None).cast("string")).otherwise(F.substring("mark", 2, 1 << 30))
    targets = source_targets(sizes.withColumn("source", named), weights, most)
    plan = stored(mix_plan(lengths, targets.select("mark", "source_size", "target"), most, fit_words), "mix-plan")
    before = Window.partitionBy("mark", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, ["mark", "size"])
              .select(F.col("mark").alias(s), F.col("size").alias(z), F.col("piece").alias(p), F.col("n").alias(n), F.col("times").alias(base),
                      F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias(quota), "source_size", "target"))
    picked = marked.join(quotas, [s, z, p])
    # ranks are read only where the count ends inside the piece
    in_piece = Window.partitionBy(s, z, p).orderBy(h, F.col(key))
    picked = picked.withColumn(rank, F.row_number().over(in_piece))
    extra = (F.col(rank) <= F.col(quota)).cast("int")
    return picked.withColumns({"size": F.col(z), "times": (F.col(base) + extra).cast("int")}).drop(*own)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix() as often as its `times` says."""
    copy = spare(mixed, "_copy")[0]
    return mixed.where("times > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("times")))).drop(copy)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix of the documents, with their own columns, also those named like mix()'s."""
    own = [c for c in docs.columns if c.lower() in ("size", "source_size", "target", "times")]
    kept = dict(zip(own, spare(docs, *[f"_own_{c}" for c in own])))
    return repeated(mix(docs.withColumnsRenamed(kept), **options)).select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])
