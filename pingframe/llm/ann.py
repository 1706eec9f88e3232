"""Approximate nearest neighbours by cross-polytope hashing: fast pseudo-rotations, multiprobe tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, stored

#: Tables, and the buckets of each table that a query looks into.  A table hashes with two rotations: (2 d)^2 buckets.
TABLES = 8
PROBES = 512
#: Nearest signed axes of a rotation that probes are combined from.
AXES = 48
SEED = 29
#: Vectors of a table that are searched together, about.
UNIT_ROWS = 1 << 14
#: Queries that are compared with all rows in one pass, if the tables give too few.
BLOCK = 2048


def _padded(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform: a pseudo-rotation of rows of a power-of-two length."""
    n, d = x.shape
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x, half = x * s, 1
        while half < d:
            pairs = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
    return x


def _axes(x: np.ndarray, seed: int) -> np.ndarray:
    """Closeness to each signed axis of a rotation: d positive, then d negative axes."""
    r = _rotated(x, seed)
    return np.concatenate([r, -r], axis=1)


def codes(x: np.ndarray, table: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest signed axes of each row: its bucket in a table."""
    return tuple(_axes(x, seed + 2 * table + i).argmax(axis=1) for i in (0, 1))


def probes(x: np.ndarray, table: int, n: int = PROBES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The n buckets whose axes are nearest to each row, as two arrays of axes; all buckets if there are fewer."""
    near, close = [], []
    for i in (0, 1):
        c = _axes(x, seed + 2 * table + i)
        order = np.argsort(-c, axis=1, kind="stable")[:, :AXES]
        near.append(order)
        close.append(np.take_along_axis(c, order, 1))
    k = near[0].shape[1]
    both = (close[0][:, :, None] + close[1][:, None, :]).reshape(len(x), -1)
    best = np.argsort(-both, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(near[0], best // k, 1), np.take_along_axis(near[1], best % k, 1)


def _unit_rows(vectors: list[np.ndarray], d: int) -> np.ndarray:
    """Rows of length 1, padded with zeros to a power of two."""
    x = np.zeros((len(vectors), _padded(d)))
    x[:, :d] = np.stack(vectors)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query in double precision, row by row alike: equal rows have equal cosines."""
    r, q = rows.astype(np.float64), query.astype(np.float64)
    r, q = r / np.abs(r).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (r * q).sum(axis=1) / np.sqrt((r * r).sum(axis=1)) / np.sqrt((q * q).sum())


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hashed(df: DataFrame, dtype: str, parts: int, asked: int, tables: int) -> DataFrame:
    """Rows (id, v) as (d, t, a, s, b, id, x): one per table, or per group of probed buckets that share their first axis and part."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = [np.asarray(v, dtype) for v in batch.column(1).to_numpy(zero_copy_only=False)]
            for d in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                x, raw = _unit_rows([vectors[i].astype(np.float64) for i in at], d), [vectors[i].tobytes() for i in at]
                for t in range(tables):
                    if not asked:
                        a, b = codes(x, t)
                        out = [[d] * len(at), [t] * len(at), a, b % parts, [np.uint16([v]).tobytes() for v in b], ids[at], raw]
                    else:
                        out = [[] for _ in range(7)]
                        for i, (a, b) in enumerate(zip(*probes(x, t, asked))):
                            order = np.lexsort((b % parts, a))
                            a, b = a[order], b[order]
                            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] % parts != b[:-1] % parts), True])
                            for lo, hi in zip(cut, cut[1:]):
                                for c, v in zip(out, (d, t, a[lo], b[lo] % parts, b[lo:hi].astype(np.uint16).tobytes(), ids[at[i]], raw[i])):
                                    c.append(v)
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["d", "t", "a", "s", "b", "id", "x"])

    return df.mapInArrow(rows, "d int, t int, a int, s int, b binary, id long, x binary")


def _top(sims: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, and of all that rounding may hide among them."""
    return np.flatnonzero(sims >= np.partition(sims, -n)[-n] - 1e-9) if len(sims) > n else np.arange(len(sims))


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: largest score, then smallest id."""
    return np.lexsort((ids, -score))[:n]


def _searched(work: DataFrame, dtype: str, keep: int) -> DataFrame:
    """(query, id, score): the best `keep` candidates of each query in each unit of rows (unit, role, b, id, x) sorted by unit and role."""
    def search(unit: list) -> list[tuple]:
        roles, bs, ids, xs = unit
        rows = [i for i, r in enumerate(roles) if r == 0]
        asked = [i for i, r in enumerate(roles) if r == 1]
        if not rows or not asked:
            return []
        raw = np.stack([np.frombuffer(xs[i], dtype) for i in rows])
        b = np.array([np.frombuffer(bs[i], np.uint16)[0] for i in rows])
        order = np.argsort(b, kind="stable")
        raw, b, own = raw[order], b[order], np.array([ids[i] for i in rows])[order]
        unit_rows = _unit_rows(list(raw.astype(np.float64)), raw.shape[1])[:, :raw.shape[1]]
        out = []
        for i in asked:
            wanted = np.frombuffer(bs[i], np.uint16)
            lo, hi = np.searchsorted(b, wanted, "left"), np.searchsorted(b, wanted, "right")
            some = [np.arange(x, y) for x, y in zip(lo, hi) if y > x]
            if not some:
                continue
            at = np.concatenate(some)
            q = np.frombuffer(xs[i], dtype)
            at = at[_top(unit_rows[at] @ _unit_rows([q.astype(np.float64)], len(q))[0, :len(q)], keep)]
            score = cosines(raw[at], q)
            out += [(ids[i], int(own[at[j]]), float(score[j])) for j in _first(score, own[at], keep)]
        return out

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [[], [], [], []], None
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            found = []
            for unit, *row in zip(*cols):
                if unit != now:
                    found += search(held)
                    held, now = [[], [], [], []], unit
                for c, v in zip(held, row):
                    c.append(v)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["query", "id", "score"])
        if found := search(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["query", "id", "score"])

    return work.mapInArrow(units, "query long, id long, score double")


def _scanned(rows: DataFrame, queries: DataFrame, dtype: str, keep: int) -> DataFrame | None:
    """(query, id, score) of the best rows of all for each query: blocks of queries, a pass over the rows for each; None without queries."""
    out, block = None, []

    def one_pass(block: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(block)                 # BLOCK vectors

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, vectors, found = batch.column(0).to_pylist(), [np.asarray(v, dtype) for v in batch.column(1).to_numpy(zero_copy_only=False)], []
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                x = np.stack([vectors[i] for i in at])
                for q, v in shared.value:
                    if len(v) == d:
                        c = cosines(x, np.asarray(v, dtype))
                        found += [(q, ids[at[j]], float(c[j])) for j in _first(c, np.array([ids[i] for i in at]), keep)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [pa.int64(), pa.int64(), pa.float64()])], ["query", "id", "score"]) if found else None

        return map_arrow(rows, scan, "query long, id long, score double")

    for row in queries.toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == BLOCK:
            out, block = (one_pass(block) if out is None else out.unionByName(one_pass(block))), []
    if block:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
            n_probes: int = PROBES, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(query_id, rank, key, score): for each row that `queries` marks its k nearest other rows by cosine, ties to the smaller key.

    Equal vectors are searched once, and stand for their k + 1 smallest keys:
    more cannot be among the nearest.  A vector's bucket in a table are its
    nearest signed axes after two pseudo-rotations; a query looks into the
    buckets whose axes are nearest to its own rotations.  Buckets that share the
    first axis make a unit, large units are dealt into parts, and queries go to
    each part they look into; a unit gives each query's best few, so pairs are
    never listed.  Scores are cosines of the given vectors in double precision.
    Queries for which the tables give fewer than k others are compared with all
    rows, in blocks.

    Null, empty and zero vectors and those with null or non-finite components
    take no part, nor do null keys; vectors meet only those of their own
    dimension.  Of rows that repeat a key none is a candidate for the other.
    Other columns are not read.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    fine = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    dtype = "float32" if dict(vectors.dtypes)[vector] == "array<float>" else "float64"
    fine = stored(fine.withColumn("v", F.col("v").cast("array<float>" if dtype == "float32" else "array<double>")), "ann-rows")
    few = fine.select("v", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    reps = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)), "ann-vectors")
    total = reps.count()
    parts = max(1, -(-total // (128 * unit_rows)))
    asked = stored(fine.where("q").select("v", "id").distinct().join(reps.select("v", "rep"), "v").select("id", "rep", "v"), "ann-queries")
    asked_reps = asked.select("rep", "v").dropDuplicates(["rep"])
    unit = ["d", "t", "a", "s"]
    rows = stored(_hashed(reps.select("rep", "v").repartition(spark.sparkContext.defaultParallelism), dtype, parts, 0, tables), "ann-tables")
    sizes = rows.groupBy(*unit).agg(F.ceil(F.count(F.lit(1)) / unit_rows).cast("int").alias("splits"))
    placed = rows.join(sizes, unit).withColumn("p", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).withColumn("role", F.lit(0))
    looked = _hashed(asked_reps.repartition(spark.sparkContext.defaultParallelism), dtype, parts, n_probes, tables).join(sizes, unit)
    looked = looked.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).withColumn("role", F.lit(1))
    work = (placed.unionByName(looked).select(F.xxhash64(*unit, "p").alias("unit"), "role", "b", "id", "x")
            .repartition("unit").sortWithinPartitions("unit", "role"))
    found = _searched(work, dtype, k + 1)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")

    def top(df: DataFrame) -> DataFrame:
        return df.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    found = stored(top(found), "ann-found")
    others = reps.groupBy(F.size("v").alias("d")).agg(F.sum(F.size("ids")).alias("there"))
    got = (found.join(reps.select(F.col("rep").alias("id"), F.size("ids").alias("n"), F.size("v").alias("d")), "id").groupBy("query").agg(F.sum("n").alias("n"), F.max("d").alias("d")))
    enough = got.join(others, "d").where(F.col("n") >= F.least(F.lit(k + 1), F.col("there"))).select(F.col("query").alias("rep"))
    short = stored(asked_reps.join(enough, "rep", "left_anti"), "ann-short")
    scanned = _scanned(reps.select("rep", "v"), short, dtype, k + 1)
    if scanned is not None:
        found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(top(scanned))
    named = found.join(reps.select(F.col("rep").alias("id"), "ids"), "id").select("query", "score", F.explode("ids").alias("other"))
    ranked = (asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(named, "query").where("other <> query_id")
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "other"))).where(F.col("rank") <= k))
    return ranked.select("query_id", "rank", F.col("other").alias(key), "score")
