"""Token sequences of bounded length: bounded-space best-fit packing in each partition, leftovers merged in rounds."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import released, spare, stored

#: Ids in a sequence, windows a task keeps open, id that ends a document.
CAPACITY = 1024
WINDOWS = 32
END = 0
#: Leftover windows that one task of a merging round takes.
MERGED = 2048

#: Fixed value: how byte-level vocabularies of this family cut a text into what is merged by itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit bytes, from a file of ranks (base64 and id in a line).

    Strings of special tokens are ordinary text.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> bytes:
        return np.array(encode(text), "<u4").tobytes()

    return ids


class Windows:
    """A fixed number of open sequences: a piece goes where it fits best, and the fullest leaves when it fits nowhere.

    A piece is (row, start, ids).  A sequence that leaves is first filled with
    the head of the piece that fitted nowhere: it has no padding, and texts are
    cut there only.
    """

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[list] = []             # [free places, pieces]

    def add(self, row: tuple, start: int, ids: bytes) -> Iterator[list]:
        while len(ids) >= 4 * self.capacity:   # whole sequences need no window
            yield [(row, start, ids[:4 * self.capacity])]
            start, ids = start + self.capacity, ids[4 * self.capacity:]
        while ids:
            n = len(ids) // 4
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [self.capacity, []])
            if best is not None:
                best[0] -= n
                best[1].append((row, start, ids))
                if not best[0]:
                    self.open.remove(best)
                    yield best[1]
                return
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            room = fullest[0]
            yield [*fullest[1], (row, start, ids[:4 * room])]
            start, ids = start + room, ids[4 * room:]

    def rest(self) -> list[list]:
        out, self.open = [pieces for _, pieces in self.open], []
        return out


def _in_powers(pieces: list, capacity: int) -> Iterator[list]:
    """The pieces of less than a sequence dealt to sequences whose lengths are powers of two, the largest first: no padding."""
    out, total = [], sum(len(ids) // 4 for _, _, ids in pieces)
    room = 0
    for row, start, ids in pieces:
        while ids:
            room = room or min(capacity, 1 << (total.bit_length() - 1))
            n = min(room, len(ids) // 4)
            out.append((row, start, ids[:4 * n]))
            start, ids, room, total = start + n, ids[4 * n:], room - n, total - n
            if not room:
                yield out
                out = []


def _batches(sequences: Iterator[tuple[int | None, list]], keep: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces of numbered sequences, some 4 MB a batch; ids of pieces that have a number stay if `keep`."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for number, pieces in sequences:
        offset = 0
        for (key, total), start, ids in pieces:
            n, kept = len(ids) // 4, ids if keep or number is None else None
            held.append((key, start, n, zlib.crc32(ids), total, number, offset, kept))
            offset += n
            size += 100 + len(kept or b"")
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS,
         end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces of all texts in sequences of at most `capacity` ids (a power of two), without padding.

    (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a
    text's ids are the tokenizer's with `end` after them, `doc_tokens` of them
    in all, cut into pieces; `start` counts the text's ids before the piece and
    `offset` the sequence's.  `ids` are little-endian unsigned 32-bit integers;
    they are left out if not kept.  Every sequence has `capacity` ids, but for
    those of the last leftover: at most one of each lesser power of two.

    Each task packs its own rows with a fixed number of open windows.  What is
    in them at the end goes into rounds of fewer tasks, of about `MERGED`
    windows each, until one task gets them all; so no task grows with the table.
    A repeated task must see its rows in the same order, as it does from files.

    A null text is empty, so `end` alone; blank texts are packed as they are.
    Repeated rows and rows with a null key are rows like others, with pieces of
    their own.  Very long texts become whole sequences.  An empty table has no
    pieces.  Other columns are not read; result columns whose names the key
    takes get a leading underscore.
    """
    start, length, crc, total, number, offset, ids = spare(docs.select(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in (start, length, crc, total, number, offset)), T.StructField(ids, T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    tail = np.array([end], "<u4").tobytes()

    def numbered(sequences: Iterator[list], level: int) -> Iterator[tuple[int, list]]:
        base = (level << 58) + (TaskContext.get().partitionId() << 34)
        return ((base + i, pieces) for i, pieces in enumerate(sequences))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, space = encoder(tokenizer), Windows(capacity, windows)

        def full() -> Iterator[list]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = ids_of(batch.column(1)[i].as_py() or "") + tail
                    yield from space.add((batch.column(0)[i].as_py(), len(got) // 4), 0, got)

        yield from _batches(numbered(full(), 0), keep_ids, arrow)
        yield from _batches(((None, pieces) for pieces in space.rest()), keep_ids, arrow)

    def merging(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, final = Windows(capacity, windows), Windows(capacity, 1)

            def full() -> Iterator[list]:
                for b in batches:
                    for k, t, s, i in zip(*(c.to_pylist() for c in b.columns)):
                        yield from space.add((k, t), s, i)
                if last:                       # one window, then lengths without padding
                    for pieces in sorted(space.rest(), key=len):
                        for row, s, i in pieces:
                            yield from final.add(row, s, i)
                    for pieces in final.rest():
                        yield from _in_powers(pieces, capacity)

            yield from _batches(numbered(full(), level), keep_ids, arrow)
            yield from _batches(((None, pieces) for pieces in space.rest()), keep_ids, arrow)

        return released(merge)

    done, level = [], 0
    got = stored(docs.select(key, text).mapInArrow(released(first), schema), "packing-rows")
    tasks = 0
    while tasks != 1:
        done.append(got.where(F.col(number).isNotNull()))
        left, level = got.where(F.col(number).isNull()), level + 1
        needed = max(1, -(-left.where(F.col(offset) == 0).count() // MERGED))
        tasks = min(needed, tasks - 1) if tasks else needed
        order = [F.col(length).desc(), F.col(key), F.col(start), F.col(crc)]
        spread = left.repartition(tasks).sortWithinPartitions(*order).select(key, total, start, ids)
        got = stored(spread.mapInArrow(merging(level, tasks == 1), schema), "packing-merged")
    out = got
    for d in done:
        out = out.unionByName(d)
    return out if keep_ids else out.drop(ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack()'s pieces with their ids: the ids of each sequence joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
