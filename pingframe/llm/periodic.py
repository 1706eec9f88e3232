"""Periodic runs of words: seeds of guaranteed overlap, extended along their diagonal once per lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

#: A run repeats its period at least so often, over at least so many words.
REPEATS = 4
SHORTEST = 6
#: Texts (bytes) that a task works on at once.
BLOCK = 4 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def _overlap(lag: int) -> int:
    """Words that a run of this period shares, at least, with itself moved by one period."""
    return max(SHORTEST - lag, (REPEATS - 1) * lag)


def _named(key: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers from 0."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
    return out


def _grown(names: np.ndarray, k: int, to: int) -> tuple[np.ndarray, int]:
    """Names of the k-grams made names of the `to`-grams: two that overlap name a longer one; no hash, so no collision."""
    while k < to:
        if int(names.max()) >= 1 << 31:
            names = _named(names)
        m = min(to, 2 * k)
        a, b = names[:len(names) - (m - k)], names[m - k:]
        names, k = a * (int(names.max()) + 1) + b, m
    return names, k


def _same(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around `at` with ids[i] == ids[i + lag]: blocks of doubling size are compared each way."""
    n, stop, size = len(ids) - lag, at, 64
    while stop < n:
        end = min(n, stop + size)
        odd = np.flatnonzero(ids[stop:end] != ids[stop + lag:end + lag])
        if len(odd):
            stop += int(odd[0])
            break
        stop, size = end, 2 * size
    start, size = at, 64
    while start > 0:
        low = max(0, start - size)
        odd = np.flatnonzero(ids[low:start] != ids[low + lag:start + lag])
        if len(odd):
            start = low + int(odd[-1]) + 1
            break
        start, size = low, 2 * size
    return start, stop


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs in a sequence of word numbers, by start and period.

    Lags are taken in classes from `low` to `high`, whose k-grams have the
    overlap that a run of period `low` guarantees; `high` is at most k.  In a run
    of period q the next occurrence of such a k-gram is q places on: a nearer one
    would give the run a smaller period, as the k-gram covers a period.  So the
    pairs of neighbouring occurrences are all that is enumerated, at most one for
    each place, and their stretches have their lag as smallest period.
    """
    n, low, found = len(ids), 1, []
    k, names = 1, ids
    while REPEATS * low <= n and SHORTEST <= n:
        grams = _overlap(low)
        high = max(q for q in range(low, grams + 1) if _overlap(q) >= grams)
        names, k = _grown(names, k, grams)
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(names[order][1:] == names[order][:-1])
        if not len(again):
            break                                            # longer grams do not repeat either
        first = order[again]
        lag = order[again + 1] - first
        fit = (lag >= low) & (lag <= high)
        first, lag = first[fit], lag[fit]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        at, covered = 0, {}                                  # per lag, the place up to which its diagonal is covered
        while at < len(first):
            q = int(lag[at])
            if first[at] >= covered.get(q, 0):
                start, stop = _same(ids, int(first[at]), q)
                covered[q] = stop
                if stop - start >= _overlap(q):
                    found.append((start, stop - start + q, q))
            end = int(np.searchsorted(lag, q, "right"))      # on to the first pair of the lag that is not covered
            at += int(np.searchsorted(first[at:end], covered[q]))
        low = high + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _described(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    words = (text or b"").split()                            # bytes split at the six ASCII spaces
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(index) < SHORTEST - 1:               # a run repeats all but its first period
        return [], b" ".join(words)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    runs = runs_of(ids)
    if not runs:
        return runs, b" ".join(words)
    return runs, b" ".join([words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()])


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add each text's maximal periodic runs of words and the text with every run cut to its first period.

    `runs` is an array of (start, length, period) in words from 0, by start and
    period; a run's smallest period fits into it four times at least and it has
    six words at least.  `collapsed` has the words that no run contains after
    its first period, joined by one space.  Null, empty and blank texts have no
    runs and collapse to the empty text.  Every row is kept, repeated ones and
    null keys too; a text of any length is worked on whole, in the task of its
    row.  Columns named like the two new ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c != text and c.lower() in (runs.lower(), collapsed.lower())])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *docs.limit(0).select(F.lit(None).cast(RUNS).alias(runs), F.lit("").alias(collapsed)).schema.fields])
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(BLOCK * whole.num_rows / max(1, whole.nbytes)))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                got = [_described(t.as_py()) for t in batch.column(at).cast(pa.binary())]
                flat = np.array([x for r, _ in got for x in r], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *(len(r) for r, _ in got)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(entry)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([c for _, c in got], pa.binary()).cast(pa.string())], [*batch.schema.names, runs, collapsed])

    return docs.mapInArrow(released(each), schema)


def longest(runs: str):
    """The run with the greatest length; ties: smallest start, then period.  Null where there is none."""
    by = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.get(by, F.lit(0))


def written_runs(runs: str):
    """Every run as a line `start,length,period`."""
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(line, "")


__all__ = ["longest", "runs_of", "with_runs", "written_runs"]
