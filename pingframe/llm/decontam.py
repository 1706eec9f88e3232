"""Benchmark decontamination: test items found in documents within an edit budget, by exact pieces and bit-parallel verification."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, spare

#: Errors allowed, as a share of the item's length in code points after folding.
BUDGET = 0.05
#: Items that fold to less than this many code points are found as whole words without errors only.
SHORTEST = 24
#: Bytes of item texts that are sent to the tasks at a time; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20

_GAPS = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Lower case, and each run of anything but letters and digits as one space."""
    return _GAPS.sub(" ", text.lower()).strip()


def pieces_of(item: str, budget: float = BUDGET) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k, and k + 1 nearly equal pieces with their offsets: k errors leave one piece untouched."""
    k = int(len(item) * budget)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_within(masks: dict[str, int], m: int, window: str, k: int) -> tuple[int, int] | None:
    """Myers' bit-parallel matching: (distance, end) of the nearest occurrence of an item of length m in the window, the first such end; None above k.

    Columns of the edit matrix are held as bit vectors of their vertical
    differences (up, down); only the score of the last row is followed.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m if m <= k else k + 1, 0
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 & full                   # row 0 stays 0: an occurrence may start anywhere
        left = left << 1 & full
        vertical = eq | down
        up, down = left | ~(vertical | right) & full, right & vertical
        if score < best:
            best, end = score, j
    return (best, end) if best <= k else None


class Finder:
    """Items ready to be searched for: one automaton over all pieces, bit masks made when an item is first verified."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET, shortest: int = SHORTEST):
        self.items, self.masks, self.shortest, pieces = items, {}, shortest, {}
        self.k = []
        for n, (_, text) in enumerate(items):
            k, parts = pieces_of(text, budget if len(text) >= shortest else 0.0)
            self.k.append(k)
            for offset, piece in parts:
                pieces.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item position, least distance, end in the folded text) of the items in a folded text, each once."""
        if not self.items or not text:
            return []
        hits: dict[int, set[int]] = {}
        for at, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                hits.setdefault(n, set()).add(at - length + 1 - offset)      # where the item would start
        found = []
        for n, starts in sorted(hits.items()):
            item, k, best, reached = self.items[n][1], self.k[n], None, -1
            if len(item) < self.shortest:
                ends = (s + len(item) for s in sorted(starts) if text[s - 1:s] in ("", " ") and text[s + len(item):s + len(item) + 1] in ("", " "))
                found += [(n, 0, end) for end in [*ends][:1]]
                continue
            if n not in self.masks:
                self.masks[n] = masks_of(item)
            windows: list[list[int]] = []
            for s in sorted(starts):                                          # starts within the budget share a window
                a, b = max(0, s - k), s + len(item) + k
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                hit = best_within(self.masks[n], len(item), text[a:b], k)
                if hit and (best is None or hit[0] < best):
                    best, reached = hit[0], a + hit[1]
                if best == 0:
                    break
            if best is not None:
                found.append((n, best, reached))
        return found


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded bytes: (id, folded text), read to the driver one block at a time, equal rows once.

    Rows without text or id, and items without any letter or digit, are left out.
    """
    block, size = [], 0
    for row in benchmark.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(item, text).toLocalIterator():
        t = folded(row[1])
        if not t:
            continue
        if size >= block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], t))
        size += len(t.encode())
    if block:
        yield block


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "matches", item: str = "item_id",
                 budget: float = BUDGET, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """Add an array of (item_id, distance, chars) for the test items that a document contains within their error budgets, by item.

    Text and items are folded; an item's budget is `budget` of its length k, it
    is split into k + 1 pieces, an automaton finds the pieces exactly, and
    Myers' bit vectors give the least distance in the windows around the hits.
    The whole text is searched.  The document table is passed once for each
    block of the benchmark, without a shuffle.

    Items that fold to less than `shortest` code points are found without errors
    as whole words only, as a few errors would make them anything.  A null or
    empty text has no match; null items, items without any letter or digit and
    an empty benchmark match nothing; equal items with different ids are all
    named, repeated ids keep their nearest occurrence.
    All columns stay; one named `name` is replaced.
    """
    docs = docs.drop(name)
    out = docs.withColumn(name, F.expr("cast(array() as array<struct<item_id:bigint,distance:int,chars:int>>)"))
    small_batches(docs.sparkSession, 256)
    for block in item_blocks(benchmark, item, "text", block_bytes):
        more = spare(out, "_more")[0]
        out = _searched(out, docs.sparkSession.sparkContext.broadcast(block), text, more, budget, shortest)      # BLOCK_BYTES and one item at most
        out = out.withColumn(name, _nearest(F.concat(name, more))).drop(more)
    return out


def _nearest(matches: Column) -> Column:
    """One match for each item, by item: the rows of an id may lie in two blocks of the benchmark."""
    best = lambda k: F.array_min(F.transform(F.filter(matches, lambda m: m["item_id"] == k), lambda m: F.struct(m["distance"], m["chars"])))
    ids = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))
    return F.transform(ids, lambda k: F.struct(k.alias("item_id"), best(k)["distance"].alias("distance"), best(k)["chars"].alias("chars")))


#: The finders of a worker, which serves many tasks: the latest few.
_FINDERS: dict[str, Finder] = {}


def _searched(docs: DataFrame, block, text: str, name: str, budget: float, shortest: int) -> DataFrame:
    at, tag = docs.columns.index(text), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("chars", pa.int32())]))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tag not in _FINDERS:
            while len(_FINDERS) >= 4:
                _FINDERS.pop(next(iter(_FINDERS)))
            _FINDERS[tag] = Finder(block.value, budget, shortest)
        finder = _FINDERS[tag]
        rows = []
        for t in batch.column(at):
            best: dict[int, tuple[int, int]] = {}
            for n, distance, _ in finder.search(folded(t.as_py() or "")):
                key, length = finder.items[n][0], len(finder.items[n][1])
                best[key] = min(best.get(key, (distance, length)), (distance, length))
            rows.append([{"item_id": k, "distance": d, "chars": c} for k, (d, c) in sorted(best.items())])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    schema = docs.select("*", F.expr("cast(array() as array<struct<item_id:bigint,distance:int,chars:int>>)").alias(name)).schema
    return map_arrow(docs, search, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no test item within its error budget; columns as they were."""
    name = spare(docs, "_matches")[0]
    return with_matches(docs, benchmark, name=name, **options).where(F.size(name) == 0).drop(name)
