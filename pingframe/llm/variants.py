"""Spelling variants: words one edit apart, found in a trie of letter counts, and the frequent forms they vary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored

#: A word for the counts: letters of Latin-1, A-Z lowered.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word has at least; times a form is more frequent than its variant.
LENGTH = 5
COUNT = 3
TIMES = 2

#: Levels of the trie: the 26 letters, then groups of all other characters by code point.
_ORDER = "eaionrtslucdmpghbvfyqkwxjz"
LEVELS = 32
MOST = 15
#: Words in a part of the trie, parts at most (the bound of what is sent to every task), words sampled to choose them.
PART = 8000
PARTS = 4096
SAMPLE = 20_000
#: Words under a node at which the search stops; search states and pairs held at once.
FEW = 4
STATES = 1 << 17


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word) of every run of letters in the texts, A-Z lowered; a null text has none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(key, F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))


def counted(found: DataFrame, length: int = LENGTH, least: int = COUNT) -> DataFrame:
    """(word, n) of the words of `length` code points and `least` occurrences at least; counts combine before they move."""
    return found.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _points(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word begins."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    return np.frombuffer("".join(held).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum(sizes)]


def _counts(held: list[str]) -> np.ndarray:
    """A row of letter counts for each word: its path in the trie."""
    points, at = _points(held)
    level = np.where(points < 128, _LEVEL[np.minimum(points, 127)], len(_ORDER) + points % (LEVELS - len(_ORDER)))
    word = np.repeat(np.arange(len(held)), np.diff(at))
    return np.minimum(np.bincount(word * LEVELS + level, minlength=len(held) * LEVELS).reshape(-1, LEVELS), MOST).astype(np.uint8)


_LEVEL = np.array([_ORDER.find(chr(c)) if chr(c) in _ORDER else len(_ORDER) + c % (LEVELS - len(_ORDER)) for c in range(128)])


class Trie:
    """The trie of some paths as a sorted array: a node is the range of rows that share its counts so far."""

    def __init__(self, paths: np.ndarray):
        self.size = len(paths)
        node, self.keys, self.nodes = np.zeros(len(paths), np.int64), [], []
        for level in range(LEVELS):
            key = node * (MOST + 1) + paths[:, level]
            self.keys.append(key)
            node = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else node
            self.nodes.append(node)

    def near(self, paths: np.ndarray, few: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, first row, end row) of the nodes where the search ends: with `few` rows at most, or with one path.

        The search goes down depth first with a block of states at a time; a block
        too large is halved, and one half waits.  A level takes the query's count, one more if no surplus was spent yet, or one less
        if no deficit was: one edit changes two counts by one at most, up and down.
        """
        n = len(paths)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, bool), np.zeros(n, bool))]
        while stack:
            level, query, node, low, high, more, less = stack.pop()
            over = (high - low <= few) | (level == LEVELS)
            yield query[over], low[over], high[over]
            state = [x[~over] for x in (query, node, low, high, more, less)]
            if len(state[0]) > STATES:
                half = len(state[0]) // 2
                stack += [(level, *(x[:half] for x in state)), (level, *(x[half:] for x in state))]
                continue
            if not len(state[0]):
                continue
            query, node, low, high, more, less = state
            count, keys, nodes = paths[query, level].astype(np.int64), self.keys[level], self.nodes[level]
            below = []
            for step, open_ in ((0, None), (1, ~more), (-1, ~less)):
                some = np.arange(len(query)) if open_ is None else np.flatnonzero(open_ & (count + step >= 0) & (count + step <= MOST))
                key = node[some] * (MOST + 1) + count[some] + step
                a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                below.append((query[some], nodes[np.minimum(a, self.size - 1)], a, b, more[some] | (step == 1), less[some] | (step == -1)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*below))))


def _sorted(paths: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(paths).view(f"S{LEVELS}").ravel() if len(paths) else np.zeros(0, "S1"), kind="stable")


def _one_edit(points: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks the pairs of words a, b that exactly one inserted, deleted or replaced code point makes equal."""
    size = np.diff(at)
    a, b = np.where(size[a] >= size[b], a, b), np.where(size[a] >= size[b], b, a)      # a is the longer one
    ok = np.zeros(len(a), bool)
    longer, shorter = size[a], size[b]
    fit = np.flatnonzero(longer - shorter <= 1)
    for length in np.unique(longer[fit]).tolist():
        same = fit[longer[fit] == length]
        step = max(1, (1 << 22) // length)
        for i in range(0, len(same), step):
            k = same[i:i + step]
            x = points[at[a[k]][:, None] + np.arange(length)]
            equal = shorter[k] == length
            y = points[np.minimum(at[b[k]][:, None] + np.arange(length), len(points) - 1)]
            differ = x != y
            one = differ.sum(axis=1) == 1
            cut = length - 1                                     # one deleted: what follows the first difference is moved by one
            first = np.where(differ[:, :cut].any(axis=1), differ[:, :cut].argmax(axis=1), cut)
            moved = (x[:, 1:] != y[:, :cut]) & (np.arange(cut) >= first[:, None])
            ok[k] = np.where(equal, one, ~moved.any(axis=1))
    return ok


def _spans(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(span, row) of the rows of spans, some `STATES` at a time; a span stays whole."""
    n = high - low
    ends = np.cumsum(n)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(STATES, int(ends[-1]), STATES)), len(n)]) if len(n) else []
    for i, j in zip(cuts, cuts[1:]):
        span = np.repeat(np.arange(i, j), n[i:j])
        yield span, np.arange(len(span)) - (ends[span] - n[span] - (ends[i] - n[i])) + low[span]


def _search(members: list[str], counts: np.ndarray, queries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, its near members, the best of them): the most frequent, of equals the first in code-point order."""
    paths = _counts(members)
    order = _sorted(paths)
    points, at = _points(members + queries)
    rank = np.empty(len(members), np.int64)
    rank[sorted(range(len(members)), key=members.__getitem__)] = np.arange(len(members))
    found = [np.zeros((2, 0), np.int64)]
    for query, low, high in Trie(paths[order]).near(_counts(queries), FEW):
        for span, row in _spans(low, high):
            q, m = query[span], order[row]
            ok = _one_edit(points, at, m, q + len(members))
            found.append(np.stack([q[ok], m[ok]]))
    q, m = np.concatenate(found, axis=1)
    best = np.lexsort((rank[m], -counts[m], q))
    q, m = q[best], m[best]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][:len(q)])
    return q[first], np.diff(np.r_[first, len(q)]), m[first]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _spread(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word as member (role 0) of its part of the trie and as query (role 1) to every part within an edit of it."""
    trie, starts = Trie(edges), np.ascontiguousarray(edges).view(f"S{LEVELS}").ravel()
    for b in batches:
        held, n = _strings(b.column(0)), b.column(1).to_numpy()
        paths = _counts(held)
        home = np.searchsorted(starts, paths.view(f"S{LEVELS}").ravel(), "right") if len(starts) else np.zeros(len(held), np.int64)
        pairs = np.unique(np.concatenate([query * (len(starts) + 1) + high for query, _, high in trie.near(paths, 0)]))
        query = pairs // (len(starts) + 1)
        part, role = np.r_[home, pairs % (len(starts) + 1)], np.r_[np.zeros(len(held), np.int32), np.ones(len(query), np.int32)]
        row = pa.array(np.r_[np.arange(len(held)), query])
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(role.astype(np.int32)), b.column(0).take(row), pa.array(np.r_[n, n[query]])], ["part", "role", "word", "n"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, which come together but may cross batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for i, j in zip(cuts, cuts[1:]):
            if held and j > i and held[-1].column(0)[0].as_py() != part[i]:
                yield pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _parts(batches):
        t = t.combine_chunks()
        inside = int(np.searchsorted(t["role"].to_numpy(), 1))
        held, n = _strings(t["word"]), t["n"].to_numpy()
        if not inside:
            continue
        query, near, best = _search(held[:inside], n[:inside], held[inside:])
        for i in range(0, len(query), 50_000):
            q, m = query[i:i + 50_000] + inside, best[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([t["word"].combine_chunks().take(pa.array(q)), pa.array(near[i:i + 50_000]), pa.array(n[m]), t["word"].combine_chunks().take(pa.array(m))],
                                             ["word", "n_near", "top_n", "top"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, top_n, top) for the rows (word, n) that have words one edit away: how many, and the most frequent of them.

    The trie of letter counts is cut into parts of some `PART` words by paths of
    a sample, which only decides how even the parts are; tasks get the cuts, at
    most `PARTS` paths.  A word goes as member to its own part and as query to
    the parts that an edit of it can reach; a part lists no pairs, but a row for
    each query with its number and best.
    """
    parts = min(PARTS, -(-vocabulary.count() // PART))
    sample = [r.word for r in vocabulary.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    paths = _counts(sample)
    paths = paths[_sorted(paths)]
    edges = np.unique(paths[[len(paths) * i // parts for i in range(1, parts)]], axis=0) if parts > 1 else np.zeros((0, LEVELS), np.uint8)
    spread = vocabulary.select("word", "n").mapInArrow(released(lambda it: _spread(it, edges)), "part int, role int, word string, n long")
    got = spread.repartition("part").sortWithinPartitions("part", "role").mapInArrow(released(_found), "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("n"), F.col("top").alias("top")))
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("top_n"), F.col("b.top").alias("top"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round a word points to where its form pointed, so chains halve."""
    root = forms.select("word", F.col("form").alias("root"))
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("on"))
        root = stored(root.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "variants-roots")
        if root.where("moved").isEmpty():
            return root.drop("moved")
        root = root.drop("moved")


def with_forms(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row (word, n) of a vocabulary.

    Words are near if exactly one inserted, deleted or replaced code point makes
    them equal; `n_near` counts a word's.  Its `form` is the most frequent of
    them (ties: the smallest in code-point order) if that is at least `times` as
    frequent, with frequency `form_n`; `root` follows the forms to the last.
    Without form, `form` and `form_n` are null and the root is the word itself.
    Rows with a null word go, as counted() gives none; words come once each.  An
    empty vocabulary gives an empty table.
    """
    known = stored(vocabulary.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL"), "variants-words")
    near = known.join(near_words(known), "word", "left")
    has = F.col("top_n") >= times * F.col("n")
    forms = stored(near.select("word", F.when(has, F.col("top")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(has, F.col("top_n")).alias("form_n")), "variants-forms")
    root = _roots(forms.where("form IS NOT NULL").select("word", "form"))
    return forms.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def dropped_letters(found: DataFrame, key: str = "doc_id", one_in: int = 97) -> DataFrame:
    """Words (key, word) with some letters lost: h, the CRC-32 of `<key>:<word>`, picks one word in so many and its code point h % length."""
    h, at = F.col("h"), (F.col("h") % F.length("word")).cast("int")
    hashed = found.withColumn("h", F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), "word"), "UTF-8")))
    lost = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(key, F.when(h % one_in == 0, lost).otherwise(F.col("word")).alias("word"))
