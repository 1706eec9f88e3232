"""Personal data: exact patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds."""

from __future__ import annotations

import hashlib
import re
import string
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Tags of a character: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Hidden units of a direction, size of a character's vector.
HIDDEN, EMBED = 16, 12
#: Characters of a window and from one window to the next.
WINDOW, STRIDE = 64, 32
#: Documents with a digit or an at sign that the model is trained on at most (smallest hash of the text), windows of them, passes, seed.
TRAIN_DOCS, TRAIN_WINDOWS, PASSES, SEED = 1200, 3000, 10, 11
#: Least probability that each character of an added span has its tag.
SURE = 0.9

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The condition on what a span of a kind holds."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return "@" in text
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and passes_luhn(digits)
    return 9 <= len(digits) <= 15


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind's pattern that are valid; every step is linear."""
    if not _TRIGGER.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        rest = _DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            out.append((0, start, rest.end()))
            done = rest.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):                   # four numbers make a match; the next begins after its dot
            one = ".".join(parts[i:i + 4])
            if valid("ip", one):
                out.append((1, at, at + len(one)))
            at += len(one) + 1
    out += [(2, m.start(), m.end()) for m in _DIGITS.finditer(text) if valid("card", m.group())]
    out += [(3, m.start(), m.end()) for m in _PLUS.finditer(text) if valid("phone", m.group())]
    return out


# characters as the model sees them: 0 padding, lower, upper, digit, other letter, line break or tab, other, then each ASCII mark
_MARKS = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = 7 + len(_MARKS)
_ASCII = np.full(128, 6, np.uint8)
for _c in range(128):
    _ASCII[_c] = 1 if chr(_c) in string.ascii_lowercase else 2 if chr(_c) in string.ascii_uppercase else 3 if chr(_c) in string.digits else 5 if chr(_c) in "\n\r\t" else 7 + _MARKS.index(chr(_c)) if chr(_c) in _MARKS else 6


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 4).astype(np.uint8)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, an LSTM in each direction, a linear layer to tag scores, and CRF transitions; all numpy."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": draw(_SYMBOLS, EMBED) * 2, "O": draw(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(EMBED, 4 * HIDDEN), f"U{way}": draw(HIDDEN, 4 * HIDDEN), f"g{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"g{way}"][HIDDEN:2 * HIDDEN] = 1           # remember at first

    def _run(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (n, length, HIDDEN) over the windows x; `keep` what the backward pass needs."""
        table, u = self.p["E"] @ self.p[f"W{way}"] + self.p[f"g{way}"], self.p[f"U{way}"]
        n, length = x.shape
        h, c, out, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((n, length, HIDDEN), np.float32), []
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ u
            ifo, g = _sig(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tc))
            h, c = o * tc, c_new
            out[:, t] = h
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return both @ self.p["O"] + self.p["c"]

    def best_tags(self, e: np.ndarray) -> np.ndarray:
        """Viterbi over windows of emissions (n, length, TAGS)."""
        n, length, _ = e.shape
        score, back = e[:, 0] + self.p["S"], np.empty((n, length, TAGS), np.int8)
        for t in range(1, length):
            to = score[:, :, None] + self.p["T"]
            back[:, t] = to.argmax(axis=1)
            score = to.max(axis=1) + e[:, t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the sum over all taggings, probabilities of tags (n, length, TAGS), and expected transitions (TAGS, TAGS)."""
        n, length, _ = e.shape
        trans = np.exp(self.p["T"])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, length), np.float64)
        top = e.max(axis=2, keepdims=True)
        x = np.exp(e - top)
        for t in range(length):
            a = x[:, 0] * np.exp(self.p["S"]) if t == 0 else (alpha[:, t - 1] @ trans) * x[:, t]
            s = a.sum(axis=1, keepdims=True)
            alpha[:, t], scale[:, t] = a / s, s[:, 0]
        pairs = np.zeros((TAGS, TAGS))
        for t in range(length - 1, 0, -1):
            b = x[:, t] * beta[:, t] / scale[:, t, None]
            beta[:, t - 1] = b @ trans.T
            pairs += (alpha[:, t - 1].T @ b) * trans
        return np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1), alpha * beta, pairs

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the tags y."""
        n, length = x.shape
        runs = {way: self._run(x, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ self.p["O"] + self.p["c"]
        _, marg, pairs = self.marginals(e)
        de = marg.copy()
        np.subtract.at(de, (np.arange(n)[:, None], np.arange(length)[None, :], y), 1)
        de = (de / n).astype(np.float32)
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"O": np.einsum("nlh,nlt->ht", both, de), "c": de.sum(axis=(0, 1)), "T": (pairs - seen) / n, "S": marg[:, 0].mean(axis=0) - np.bincount(y[:, 0], minlength=TAGS) / n}
        one = np.eye(_SYMBOLS, dtype=np.float32)[x]
        dh_all, g["E"] = de @ self.p["O"].T, np.zeros_like(self.p["E"])
        for way, at in (("f", 0), ("b", HIDDEN)):
            w, u = self.p[f"W{way}"], self.p[f"U{way}"]
            gu, gz = np.zeros_like(u), np.zeros((_SYMBOLS, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, c, i, f, o, a, tc in reversed(runs[way][1]):
                dh = dh + dh_all[:, t, at:at + HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
                gu += h.T @ dz
                gz += one[:, t].T @ dz
                dh, dc = dz @ u.T, dc * f
            g |= {f"U{way}": gu, f"g{way}": gz.sum(axis=0), f"W{way}": self.p["E"].T @ gz}
            g["E"] += gz @ w.T
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, batch: int = 32, pace: float = 0.02, seed: int = SEED) -> Tagger:
        """Adam over shuffled batches of windows."""
        r, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for n in range(passes):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                some = order[at:at + batch]
                for k, g in self.gradients(x[some], y[some]).items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - pace * 0.75 ** n * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def _varied(kind: int, span: str, r: np.random.Generator) -> str:
    """A labelled span, or the same data written in a way that the patterns do not know."""
    if r.random() < 0.5:
        return span
    if kind == 2:
        digits = re.sub(r"[^0-9]", "", span)
        return str(r.choice([".", "  ", "/", "_"])).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        return str(r.choice(["", "00"])) + span[1:] if "(" in span else span
    if kind == 1:
        return span.replace(".", str(r.choice([" . ", ". ", "[.]"])))
    return span.replace("@", str(r.choice([" @ ", "@ ", "[@]"])))


def training_windows(texts: list[str], windows: int = TRAIN_WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows around labelled spans, as they are or varied in writing, and around digits and at signs outside of spans: symbols and tags."""
    r, xs, ys = np.random.default_rng(seed), [], []
    for text in texts:
        spans = sorted((s, e, k) for k, s, e in pattern_spans(text))
        spans = [x for i, x in enumerate(spans) if all(x[0] >= y[1] for y in spans[:i])]
        inside = np.zeros(len(text) + 1, bool)
        for s, e, _ in spans:
            inside[s:e] = True
        loose = [m.start() for m in _TRIGGER.finditer(text) if not inside[m.start()]]
        picks = [(s, e, k) for s, e, k in spans] + [(p, p, -1) for p in (r.choice(loose, min(len(loose), 4), replace=False) if loose else [])]
        for s, e, k in picks:
            left = int(s) - int(r.integers(0, max(1, WINDOW - (e - s))))
            out, tags, at = [], [], max(0, left)
            for a, b, kind in [x for x in spans if x[1] > at] + [(len(text), len(text), -1)]:
                a = max(a, at)
                out.append(text[at:a])
                tags.append(np.zeros(a - at, np.int8))
                word = _varied(kind, text[a:b], r) if kind >= 0 and a > at - 1 else ""
                tag = np.full(len(word), 2 + 2 * kind, np.int8)
                tag[:1] = 1 + 2 * kind
                out.append(word)
                tags.append(tag)
                at = b
                if sum(map(len, out)) >= WINDOW:
                    break
            x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
            sym, tag = symbols("".join(out))[:WINDOW], np.concatenate(tags)[:WINDOW]
            x[:len(sym)], y[:len(tag)] = sym, tag
            xs.append(x)
            ys.append(y)
    if not xs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int8)
    keep = r.permutation(len(xs))[:windows]
    return np.stack(xs)[keep], np.stack(ys)[keep]


def train(docs: DataFrame, text: str = "text", rows: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, passes: int = PASSES) -> Tagger | None:
    """Train on the spans that the patterns label in a bounded sample of documents; None if it holds no span."""
    with_trigger = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    cut = with_trigger.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]          # hashes are chosen before texts move
    if cut is None:
        return None
    some = with_trigger.where(F.col("h") <= cut).select("h", F.substring("t", 1, 1 << 16).alias("t")).distinct().orderBy("h", "t").limit(rows).collect()   # TRAIN_DOCS; of a very long text the model learns from the start
    x, y = training_windows([r["t"] for r in some], windows)
    return Tagger().fit(x, y, passes) if y.any() else None


@dataclass(frozen=True)
class Found:
    """(kind, start, end) of the patterns, and those that the model adds."""

    base: list[tuple[int, int, int]]
    added: list[tuple[int, int, int]]


def find_all(texts: list[str], model: Tagger | None, sure: float = SURE) -> list[Found]:
    """Spans of whole texts.

    Windows of WINDOW characters, STRIDE apart, cover each text.  Every kind
    holds a digit or an at sign, so windows without one have no span and are not
    run.  A character takes its tag from the window in whose middle it lies
    nearest; runs of begin and inside tags are spans across windows.  A span of
    the model is added if it is valid for its kind, each of its tags is
    `sure`, and it overlaps no span of the patterns.
    """
    base = [sorted(pattern_spans(t)) for t in texts]
    if model is None:
        return [Found(b, []) for b in base]
    where, at, held = [], [], []
    padded = {}
    for n, t in enumerate(texts):
        if not _TRIGGER.search(t):
            continue
        sym = symbols(t)
        count = max(1, -(-(len(sym) - WINDOW) // STRIDE) + 1)
        full = np.zeros((count - 1) * STRIDE + WINDOW, np.uint8)
        full[:len(sym)] = sym
        hot = np.flatnonzero((full == 3) | (full == 7 + _MARKS.index("@")))
        ends = np.unique(np.concatenate([np.clip(hot // STRIDE - i, 0, count - 1) for i in range(WINDOW // STRIDE)]))
        padded[n] = full
        where += [n] * len(ends)
        at += (ends * STRIDE).tolist()
        held.append(np.lib.stride_tricks.sliding_window_view(full, WINDOW)[ends * STRIDE])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if where:
        x = np.concatenate(held)
        tags, odds = np.empty(x.shape, np.int8), np.ones(x.shape, np.float32)
        for i in range(0, len(x), 1024):
            e = model.emissions(x[i:i + 1024])
            tags[i:i + 1024] = best = model.best_tags(e)
            some = np.flatnonzero(best.any(axis=1))
            if len(some):
                p = model.marginals(e[some])[1]
                odds[i + some] = np.take_along_axis(p, best[some][:, :, None].astype(np.int64), 2)[:, :, 0]
        centre = np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)
        where, at = np.array(where), np.array(at)
        for n in np.unique(where[tags.any(axis=1)]).tolist():
            size = len(padded[n])
            far, tag, odd = np.full(size, np.inf), np.zeros(size, np.int8), np.ones(size, np.float32)
            for i in np.flatnonzero(where == n):
                s = slice(at[i], at[i] + WINDOW)
                near = centre < far[s]
                far[s], tag[s], odd[s] = np.where(near, centre, far[s]), np.where(near, tags[i], tag[s]), np.where(near, odds[i], odd[s])
            kind = (tag + 1) // 2 - 1
            new = np.flatnonzero((kind >= 0) & ((tag % 2 == 1) | np.r_[True, kind[1:] != kind[:-1]]))
            for s in new.tolist():
                e = s + 1
                while e < size and kind[e] == kind[s] and tag[e] % 2 == 0:
                    e += 1
                body, k = texts[n][s:e], int(kind[s])
                e = s + len(body.rstrip())
                if body.strip() and odd[s:e].min() >= sure and valid(KINDS[k], body) and all(e <= b[1] or s >= b[2] for b in base[n]):
                    added[n].append((k, s, e))
    return [Found(b, a) for b, a in zip(base, added)]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def with_spans(docs: DataFrame, model: Tagger | None, text: str = "text", name: str = "pii") -> DataFrame:
    """Add `name`: struct of counts by kind (long) and base_sha256 of the patterns' spans, `spans`, all spans, and n_added.

    A null text is empty: no span, and the digest of the empty text.  The whole
    text is read, in linear time.  All columns stay; one named `name` is replaced.
    """
    small_batches(docs.sparkSession, 256)
    docs = docs.drop(name)
    at, shared, tag = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex      # a few thousand weights
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        model_ = _MODELS.setdefault(tag, shared.value)
        rows = []
        for f in find_all([t or "" for t in batch.column(at).to_pylist()], model_):
            counts = np.bincount([k for k, _, _ in f.base], minlength=len(KINDS)).tolist()
            rows.append({**{f"n_{k}": c for k, c in zip(KINDS, counts)}, "base_sha256": hashlib.sha256(spelled(f.base).encode()).hexdigest(),
                         "spans": spelled(f.base + f.added), "n_added": len(f.added)})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    fields = ",".join([*(f"n_{k}:bigint" for k in KINDS), "base_sha256:string", "spans:string", "n_added:bigint"])
    return map_arrow(docs, add, docs.select("*", F.expr(f"cast(null as struct<{fields}>)").alias(name)).schema)


_MODELS: dict[str, Tagger | None] = {}
