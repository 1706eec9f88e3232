"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios and trained on labelled text."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, map_arrow, small_batches, spare, stored

#: Lengths of the n-grams of a word with its boundaries, "<word>".
LENGTHS = (3, 4, 5, 6)
#: Labelled rows the classifier is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: N-grams kept at most, and the standard errors by which a log-count ratio has to differ from 0.
FEATURES = 20_000
SURE = 3.0
#: Added to each count; weight of the squared coefficients.
SMOOTH = 1.0
RIDGE = 1.0
#: Words whose n-grams a task remembers.
MEMO = 300_000
#: Features of training rows that the fit unpacks at a time.
BLOCK = 1 << 18

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def grams_of(word: str) -> set[str]:
    """N-grams of a word with its boundary marks; a short word is one n-gram."""
    w = f"<{word}>"
    return {w[i:i + n] for n in LENGTHS for i in range(len(w) - n + 1)} or {w}


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the n-grams present); a weight is coefficient times log-count ratio."""

    weights: dict[str, float]
    bias: float


class _Scorer:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}

    def active(self, words: set[str]) -> set[str]:
        """The model's n-grams present in the words."""
        out: set[str] = set()
        memo, weights = self.memo, self.weights
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            got = memo.get(w)
            if got is None:
                # a run of letters may be as long as the text; its n-grams are a set all the same, but it is not remembered
                got = tuple(g for g in grams_of(w) if g in weights)
                if len(w) <= 40:
                    memo[w] = got
            if got:
                out.update(got)
        return out


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5,
             rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of a bounded training sample: rows whose crc32(id as text) mod `folds` is not 0, smallest hash of the id first.

    An id labelled twice counts once, with its larger label; ids or labels that
    are null do not count.  A document that occurs more than once is read once,
    with its smallest text, so that the sample is bounded however often an id is
    repeated.
    """
    ids = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc32_of_id(F.col(key)) % folds != 0))
           .groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows))
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")                     # SAMPLE_ROWS ids
            .groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"))


def _counts(sample: DataFrame) -> DataFrame:
    """(gram, with label 1, with label 0): documents that have the n-gram."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            grams = list(set(both[0]) | set(both[1]))
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([both[1][g] for g in grams], pa.int64()),
                                              pa.array([both[0][g] for g in grams], pa.int64())], ["gram", "ones", "zeros"])
            both[0].clear()
            both[1].clear()
            return out

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[1 if y > 0 else 0].update({g for w in words_of(t) for g in grams_of(w)})
                if len(both[0]) + len(both[1]) > 1_000_000:
                    yield flush()
        yield flush()
    return sample.mapInArrow(count, "gram string, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def fit_linear(ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = RIDGE, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on features of value scale[g] for g in a row, rows' features one after the other, by accelerated gradient steps; (coefficients, bias).

    Rows are worked on some at a time, so that beside the packed features only
    arrays of about BLOCK values are held.
    """
    n, starts = len(scale), np.r_[0, np.cumsum(lengths)]
    cuts = np.unique(np.r_[0, np.searchsorted(starts[1:], np.arange(BLOCK, starts[-1], BLOCK), "right"), len(lengths)])
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def sums(values: np.ndarray) -> np.ndarray:
        """Of each row, the sum of its features' values."""
        out = np.zeros(len(lengths))
        for lo, hi in spans:
            some = lo + np.flatnonzero(lengths[lo:hi])
            if len(some):
                out[some] = np.add.reduceat(values[ids[starts[lo]:starts[hi]]], starts[some] - starts[lo])
        return out

    def spread(values: np.ndarray) -> np.ndarray:
        """Of each feature, the sum of the values of its rows."""
        out = np.zeros(n)
        for lo, hi in spans:
            out += np.bincount(ids[starts[lo]:starts[hi]], np.repeat(values[lo:hi], lengths[lo:hi]), n)
        return out

    w, bias = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    v, vb, momentum = w.copy(), bias, 1.0
    u, top = np.ones(n), 1.0
    for _ in range(20):                                                     # largest curvature, by power steps
        u = scale * spread(sums(scale * u))
        top = float(np.linalg.norm(u)) or 1.0
        u /= top
    pace = 1.0 / (0.25 * (top + len(y)) + ridge)
    for _ in range(steps):
        slip = 1 / (1 + np.exp(-np.clip(vb + sums(scale * v), -30, 30))) - y
        w_new = v - pace * (scale * spread(slip) + ridge * v)
        b_new = vb - pace * slip.sum()
        m_new = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        v, vb = w_new + (momentum - 1) / m_new * (w_new - w), b_new + (momentum - 1) / m_new * (b_new - bias)
        w, bias, momentum = w_new, b_new, m_new
    return w, bias


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS,
          features: int = FEATURES) -> Model:
    """Fit on a bounded sample of labelled rows.

    The log-count ratio of an n-gram is ln of its share of the documents with
    label 1 over its share of those with label 0, both smoothed.  N-grams whose
    ratio is within SURE standard errors of 0 are left out; the rest enter a
    ridge logistic regression, scaled by the ratio.  With one class only, or no
    labelled row, the model is its bias (label share, 0 without rows).
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    sample = stored(labelled(docs, labels, key, text, label, rows=rows).repartition(spark.sparkContext.defaultParallelism), "toxicity-sample")
    n = {int(r[0] > 0): r[1] for r in sample.groupBy(F.when(F.col("y") > 0, 1).otherwise(0)).count().collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        share = (ones + 0.01) / (ones + zeros + 1)
        return Model({}, float(np.log(share / (1 - share))))
    p, q = (F.col("ones") + SMOOTH) / (ones + 2 * SMOOTH), (F.col("zeros") + SMOOTH) / (zeros + 2 * SMOOTH)
    error = F.sqrt(1 / (F.col("ones") + SMOOTH) + 1 / (F.col("zeros") + SMOOTH) - 1 / F.lit(ones + 2 * SMOOTH) - 1 / F.lit(zeros + 2 * SMOOTH))
    ratio = F.log(p / q)
    kept = (_counts(sample).select("gram", ratio.alias("r"), (F.abs(ratio) / error).alias("z")).where(F.col("z") >= SURE)
            .orderBy(F.col("z").desc(), "gram").limit(features).collect())          # FEATURES rows
    place = {r["gram"]: i for i, r in enumerate(kept)}
    scale = np.array([r["r"] for r in kept])
    grams = {g: 0.0 for g in place}
    kind = np.dtype(np.uint16 if len(kept) <= 1 << 16 else np.uint32)

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _Scorer(grams)
        rows_ = [np.array(sorted(place[g] for g in scorer.active(words_of(t))), kind).tobytes() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(rows_, pa.binary()), batch.column(1), batch.column(2)], ["g", "y", "h"])

    if not kept:
        return Model({}, float(np.log(ones / zeros)))
    # SAMPLE_ROWS rows of the n-grams that the model knows, two bytes each; in one order whatever the partitions
    data = map_arrow(sample.select("text", "y", F.xxhash64("text", "y").alias("h")), present, "g binary, y int, h long").toArrow().combine_chunks()
    order = np.argsort(data["h"].to_numpy(), kind="stable")
    packed = data["g"].take(pa.array(order)).to_pylist()
    lengths = np.array([len(g) // kind.itemsize for g in packed])
    w, bias = fit_linear(np.frombuffer(b"".join(packed), kind), lengths, (data["y"].to_numpy()[order] > 0).astype(float), scale)
    return Model({g: float(w[i] * scale[i]) for g, i in place.items() if w[i] != 0}, float(bias))


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score from 0 to 1 of the whole text; a null or empty text has the score of the bias.  Other columns stay as they are."""
    small_batches(docs.sparkSession, 512)
    docs = docs.drop(name)
    at, shared, tag = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex     # FEATURES n-grams

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scorer = _SCORERS.get(tag) or _SCORERS.setdefault(tag, _Scorer(m.weights))
        z = np.array([m.bias + sum(m.weights[g] for g in sorted(scorer.active(words_of(t)))) for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, name])

    return map_arrow(docs, add, docs.select("*", F.lit(0.0).alias(name)).schema)


_SCORERS: dict[str, _Scorer] = {}


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """The documents whose score is below `most`, columns as they were."""
    name = spare(docs, "_score")[0]
    return with_scores(docs, train(docs, labels, key, text), text, name).where(F.col(name) < most).drop(name)
