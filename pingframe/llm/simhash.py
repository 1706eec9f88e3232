"""SimHash near-duplicates: 64-bit fingerprints, linked exactly within a Hamming radius by tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, map_arrow, small_batches, spare, stored

#: Words in a shingle, seed of the hash, bits in which linked fingerprints may differ.
SHINGLE = 3
SEED = 42
RADIUS = 3
#: Of the stage that links texts by Jaccard similarity: bits in which fingerprints may differ to be tried first; texts sampled for common shingles,
#: at least and as a share, and those shingles at most; words of 64 bits that sum up a set.
WIDE = 7
SAMPLE = 4096
SHARE = 8
COMMON = 1 << 16
PARITY = 8
#: Fingerprints in a tile of the comparison; shingles whose bits are counted at once.
TILE = 4096
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, space-joined shingles with repeats.

    Fewer words than a shingle form one shingle; without words the fingerprint
    is 0.  A bit is 1 if it is set in over half of the shingles' XXH64 values.
    """
    words = (text or b"").lower().split()     # bytes lower A-Z only and split at the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    ones, n, digest, join = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        parts = zip(*(words[start + i:stop + i] for i in range(shingle)))
        hashes = np.fromiter((digest(join(x), seed) for x in parts), np.uint64, stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """Add the fingerprint as a signed long, keeping all columns.  A null or empty text has fingerprint 0."""
    small_batches(docs.sparkSession, 512)
    at = docs.columns.index(text)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at).cast(pa.binary())), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, name])

    return map_arrow(docs, add, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links that form a spanning forest of the graph of all links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    kept = []
    for i, (x, y) in enumerate(zip(ends[:len(a)].tolist(), ends[len(a):].tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def _compare(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside tile x (y None) or between tiles: exclusive-or and bit counts of blocks of rows."""
    left, right = [], []
    other = x if y is None else y
    for start in range(0, len(x), 512):
        block = x[start:start + 512]
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, :]) <= radius)
        i += start
        if y is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            a, b = x[i], other[j]
            keep = _forest(a, b)
            left.append(a[keep])
            right.append(b[keep])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _block(fp, radius: int):
    """The radius + 1 blocks of a fingerprint: within the radius two fingerprints agree in one at least."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).cast("long") for i in range(radius + 1)]


def _compare_units(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the units of work in rows (unit, role, fp) sorted by unit and role; a unit may cross batches."""
    def done(unit: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        sizes = np.diff(np.r_[starts, len(unit)])
        left, right = [], []
        small = np.repeat(sizes <= 48, sizes)                          # many little units at once: each row against the one d places on
        u, r, x = unit[small], role[small], fp[small]
        for d in range(1, 48):
            i = np.flatnonzero(u[:-d] == u[d:]) if len(u) > d else []
            if not len(i):
                break
            i = i[(np.bitwise_count(x[i] ^ x[i + d]) <= radius)]
            left.append(x[i])
            right.append(x[i + d])
        for at, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
            x, other = fp[at:at + n], role[at:at + n] == 1
            a, b = _compare(x[~other], x[other], radius) if other.any() else _compare(x, None, radius)
            left.append(a)
            right.append(b)
        a, b = np.concatenate([np.zeros(0, np.uint64), *left]), np.concatenate([np.zeros(0, np.uint64), *right])
        if len(a):
            keep = _forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["src", "dst"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        whole = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if whole:
            yield from done(*(c[:whole] for c in cols))
        held = [c[whole:] for c in cols]
    if held is not None and len(held[0]):
        yield from done(*held)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) that connect whatever distinct fingerprints (column `fp`) lie within `radius` bits of each other.

    Tiles hold fingerprints that agree in one of radius + 1 blocks of bits, so
    that no link is lost and unlike ones rarely meet, in the order of their
    population counts.  A tile meets itself and the tiles of its block whose
    population counts come within the radius of its own; other pairs of tiles
    are skipped unseen, since the counts of linked fingerprints differ by the
    radius at most.  A pair of tiles is a unit of work of bounded size, however
    common a block is, and gives a spanning forest of its links, not all pairs.
    """
    pieces = fps.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*_block(F.col("fp"), radius))).alias("b", "v"))
    block, run = Window.partitionBy("b", "v"), Window.partitionBy("b", "v").orderBy("ones")       # 65 rows at most
    counted = pieces.groupBy("b", "v", "ones").agg(F.count(F.lit(1)).alias("n"))
    counted = (counted.withColumns({"c": F.sum("n").over(run) - F.col("n"), "all": F.sum("n").over(block)}).where("all > 1")
               .select("b", "v", "ones", F.floor(F.col("c") / tile).cast("int").alias("t0"), F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    counted = stored(counted, "simhash-tiles")
    tiles = (counted.withColumn("t", F.explode(F.sequence("t0", F.col("t0") + F.col("parts") - 1)))
             .groupBy("b", "v", "t").agg(F.min("ones").alias("low"), F.max("ones").alias("high")))
    later = tiles.select("b", "v", F.col("t").alias("t2"), F.col("low").alias("low2"))
    units = tiles.join(later, ["b", "v"]).where(f"t2 >= t AND low2 - high <= {radius}").select("b", "v", "t", "t2")
    sent = units.select("b", "v", F.xxhash64("b", "v", "t", "t2").alias("unit"),
                        F.explode(F.when(F.col("t") == F.col("t2"), F.array(F.struct(F.col("t").alias("at"), F.lit(0).alias("role"))))
                                  .otherwise(F.array(F.struct(F.col("t").alias("at"), F.lit(0).alias("role")), F.struct(F.col("t2").alias("at"), F.lit(1).alias("role"))))).alias("x"))
    sent = sent.select("b", "v", "unit", F.col("x.at").alias("t"), F.col("x.role").alias("role"))
    placed = pieces.join(counted, ["b", "v", "ones"]).select("b", "v", "fp", (F.col("t0") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("t"))
    work = placed.join(sent, ["b", "v", "t"]).select("unit", "role", "fp").repartition("unit").sortWithinPartitions("unit", "role")
    return work.mapInArrow(lambda it: _compare_units(it, radius), "src long, dst long")


def simhash_groups(fingerprints: DataFrame, key: str = "doc_id", fp: str = "_fp", radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint: the smallest key reachable over links of at most `radius` bits.

    Keys are compared without nulls; a group of null keys only has a null id.
    """
    first = stored(fingerprints.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "simhash-fingerprints")
    edges = stored(links(first.select("fp"), radius).distinct(), "simhash-links")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    label = stored(components(linked, edges).select(F.col("node").alias("fp"), F.col("label")), "simhash-labels")
    groups = label.join(first, "fp").groupBy("label").agg(F.min("least").alias("_least"))
    named = label.join(groups, "label").select("fp", "_least")
    return stored(first.join(named, "fp", "left").select("fp", F.coalesce("_least", "least").alias("component_id")), "simhash-groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): 16 hex digits, and the smallest key reachable over fingerprints that differ in `radius` bits at most.

    One row per input row, repeated rows and null keys included.  Null, empty
    and blank texts share fingerprint 0 and so one group.  Other columns are
    not read.  An empty table gives an empty table.
    """
    fps = stored(with_fingerprints(docs.select(key, text), text).drop(text), "simhash-rows")
    groups = simhash_groups(fps, key, "_fp", radius)
    return (fps.join(groups.withColumnRenamed("fp", "_fp"), "_fp")
            .select(key, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest key stays (a null key counts as the largest), ties by text.

    Copies of a fingerprint go before anything moves: the rank within a
    fingerprint is limited to 1 on the map side, so a group of any size sends one
    row per task.
    """
    fp, rank = spare(docs, "_fp", "_rank")
    marked = stored(with_fingerprints(docs, text, fp), "simhash-documents")
    best = Window.partitionBy(fp).orderBy(F.col(key).asc_nulls_last(), F.col(text))
    groups = simhash_groups(marked.select(key, fp), key, fp, radius)
    first = marked.groupBy(fp).agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(fp).alias("f"))).alias("m"))
    chosen = (first.join(groups.withColumnRenamed("fp", fp), fp).groupBy("component_id").agg(F.min("m").alias("m")).select(F.col("m.f").alias(fp)))
    return (marked.withColumn(rank, F.row_number().over(best)).where(F.col(rank) == 1).drop(rank)
            .join(chosen, fp, "left_semi").select(*docs.columns))


def shingles(text: bytes | None, shingle: int = 5, seed: int = SEED) -> np.ndarray:
    """The set of a text's shingles as ascending XXH64 values, words as in fingerprint(); fewer words than a shingle form one, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest, join = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i:i + shingle]), seed) for i in range(n)), np.uint64, n))


def _bits(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles as a signed long."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[start:start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _head(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first fifth of a set and one more, common shingles last, else by hash; sets with a similarity of 0.8 share one of these."""
    if not len(hashes):
        return hashes
    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~last], hashes[last]])[:len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def _parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY slots whether an odd number of a set's shingles fall into it, as signed longs.

    The bits in which two of these differ are at most the shingles that only one of the sets has.
    """
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """(id, s) from (id, text): the shingles of a text."""
    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t.as_py()).view(np.int64) for t in batch.column(1).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], ["id", "s"])

    return map_arrow(texts, spread, "id long, s array<long>")


def common_shingles(docs: DataFrame, text: str = "text", sample: int = SAMPLE, most: int = COMMON) -> np.ndarray:
    """Hashes of the shingles that four texts of a sample have, `most` at most; the sample is one text of SHARE, `sample` texts if that is more.

    They only order shingles, so that passages which very many texts share lead
    to no candidates; whatever the sample holds, the result is the same.
    """
    n = max(1, docs.count())
    some = docs.select(F.lit(0).cast("long"), F.col(text)).where(F.pmod(F.xxhash64(text), F.lit(n)) < max(sample, n // SHARE)).distinct()
    found = _sets(some).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return np.sort(np.array([r.x for r in found.orderBy(F.desc("n"), "x").limit(most).collect()], np.int64).view(np.uint64))


def _plausible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (src, dst) without those whose parities (id, n, parity) already differ in more bits than similar sets may have shingles of their own."""
    ends = [marked.select(F.col("id").alias(e), F.col("n").alias(f"n_{e}"), F.col("parity").alias(f"p_{e}")) for e in ("src", "dst")]
    apart = sum(F.bit_count(F.get("p_src", F.lit(i)).bitwiseXOR(F.get("p_dst", F.lit(i)))) for i in range(PARITY))
    return pairs.join(ends[0], "src").join(ends[1], "dst").where(9 * apart <= F.col("n_src") + F.col("n_dst")).select("src", "dst")


def _confirmed(pairs: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (src, dst) of texts (id, text) whose sets of shingles have a Jaccard similarity of 0.8 at least."""
    pairs = stored(_plausible(pairs, marked), "similar-candidates")
    needed = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    sets = stored(_sets(texts.join(needed, "id", "left_semi").dropDuplicates(["id"])), "similar-sets")
    both = (pairs.join(sets.select(F.col("id").alias("src"), F.col("s").alias("s1")), "src").join(sets.select(F.col("id").alias("dst"), F.col("s").alias("s2")), "dst")
            .select("src", "dst", (F.size("s1") + F.size("s2")).alias("n"), F.size(F.array_intersect("s1", "s2")).alias("shared")))
    return stored(both.where("9L * shared >= 4L * n").select("src", "dst"), "similar-links")


def _met(heads: DataFrame) -> DataFrame:
    """(src, dst) of the texts of different groups, from rows (x, p, id, n, g), whose sets may have a similarity of 0.8: the shingle x in place p may be the first they share.

    Sets so alike share 4/9 of their joint size.  Before the first shingle that
    they share they have nothing in common, so both must have as many shingles
    from there on; that shingle is in both heads.
    """
    a, b = heads.selectExpr("x", "id AS src", "n - p AS r1", "n AS n1", "g AS g1"), heads.selectExpr("x", "id AS dst", "n - p AS r2", "n AS n2", "g AS g2")
    return a.join(b, "x").where("g1 < g2 AND 9L * r1 >= 4L * (n1 + n2) AND 9L * r2 >= 4L * (n1 + n2)").select("src", "dst").distinct()


def _labelled(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of the texts that have a link."""
    linked = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return stored(components(linked, edges).select(F.col("node").alias("id"), "label"), "similar-labels")


def _forest_of(marked: DataFrame, fp: str, radius: int) -> DataFrame:
    """(src, dst) of texts whose fingerprints lie within the radius, as a spanning forest."""
    first = stored(marked.groupBy(F.col(fp).alias("fp")).agg(F.min("id").alias("rep")), "similar-fingerprints")
    ends = [first.select(F.col("fp").alias(e), F.col("rep").alias(f"{e}_id")) for e in ("src", "dst")]
    near = links(first.select("fp"), radius).join(ends[0], "src").join(ends[1], "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    alike = marked.select("id", F.col(fp).alias("fp")).join(first, "fp").where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    return near.unionByName(alike).distinct()


def similar(marked: DataFrame, texts: DataFrame, radius: int = WIDE) -> DataFrame:
    """(src, dst) that connect all rows (id, n, fp, fp2, parity, head) whose texts (id, text) have a Jaccard similarity of shingles of 0.8 at least.

    First the fingerprints are linked by tiles, within `radius` bits, and the
    links, a spanning forest, confirmed by the sets themselves: that joins most
    near copies, in groups of any size, by a row for each text.  A second
    fingerprint does so for texts that the first one leaves apart.  What both
    miss lies between two groups: sets so alike share one of their heads, early
    enough in both for what must follow.  Texts of different groups that do are
    confirmed as well, so no link is missed.
    """
    sure = _confirmed(_forest_of(marked, "fp", radius), marked, texts)
    label = _labelled(marked, sure)
    ends = [label.select(F.col("id").alias(e), F.col("label").alias(f"{e}_in")) for e in ("src", "dst")]
    apart = _forest_of(marked, "fp2", radius).join(ends[0], "src", "left").join(ends[1], "dst", "left").where("coalesce(src_in, src) <> coalesce(dst_in, dst)")
    sure = sure.unionByName(_confirmed(apart.select("src", "dst"), marked, texts))
    label = _labelled(marked, sure)
    named = marked.select("id", "n", "head").join(label, "id", "left").select("id", "n", F.coalesce("label", "id").alias("g"), F.posexplode("head").alias("p", "x"))
    between = named.groupBy("x").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("x")
    heads = stored(named.join(between, "x", "left_semi"), "similar-between")
    return sure.unionByName(_confirmed(_met(heads), marked, texts))


def keep_one_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """keep_one() with documents linked by a Jaccard similarity of their five-word shingles of 0.8 at least; texts without words are alike.

    Of a group the row with the smallest key stays (a null key counts as the
    largest), ties by a hash of the text.  Texts are written once, and move
    when the rows that stay are picked.
    """
    row, name, n, fp, fp2, parity, head = spare(docs, "_row", "_set", "_n", "_fp", "_fp2", "_parity", "_head")
    small_batches(docs.sparkSession, 512)
    at, common = docs.columns.index(text), common_shingles(docs, text)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t.as_py()) for t in batch.column(at).cast(pa.binary())]
        ids = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in held), np.uint64, batch.num_rows)
        other = [(x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) for x in held]
        more = [pa.array(ids.view(np.int64)), pa.array([len(x) for x in held], pa.int32()), pa.array([_bits(x) for x in held], pa.int64()), pa.array([_bits(x ^ (x >> np.uint64(32))) for x in other], pa.int64()),
                pa.array([_parity(x) for x in held], pa.list_(pa.int64())), pa.array([_head(x, common).view(np.int64) for x in held], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, name, n, fp, fp2, parity, head])

    long = F.lit(0).cast("long")
    marked = map_arrow(docs, add, docs.select("*", long.alias(name), F.lit(0).alias(n), long.alias(fp), long.alias(fp2), F.array(long).alias(parity), F.array(long).alias(head)).schema)
    marked = stored(marked.withColumn(row, F.monotonically_increasing_id()), "similar-documents")
    narrow = marked.select(F.col(name).alias("id"), F.col(n).alias("n"), F.col(fp).alias("fp"), F.col(fp2).alias("fp2"), F.col(parity).alias("parity"), F.col(head).alias("head"))
    narrow = stored(narrow.dropDuplicates(["id"]), "similar-heads")                        # equal sets once
    edges = similar(narrow, marked.select(F.col(name).alias("id"), F.col(text).alias("text")))
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(row).alias("row"))
    best = marked.groupBy(F.col(name).alias("id")).agg(F.min(place).alias("m")).join(_labelled(narrow, edges), "id", "left")
    kept = stored(best.groupBy(F.coalesce("label", "id").alias("label")).agg(F.min("m").alias("m")).select(F.col("m.row").alias(row)), "similar-kept")
    return marked.join(kept, row, "left_semi").select(*docs.columns)
