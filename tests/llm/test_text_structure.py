"""Periodic runs, spelling variants and packing against brute force, and awkward rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pingframe.llm import packing, periodic, variants

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, runs string, Collapsed int, start string, word string"
AWKWARD = [None, "", " \n\t", "one", "a " * 3000, "x y z " * 500, "Ünïcödé 　 x", "same text here now", "same text here now"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "r", 1, "s", "w") for i, t in enumerate(texts)] + [(None, "no id at all", "r", 1, "s", "w")] * 2, DOCS).repartition(3, "doc_id")


# --- periodic runs ---

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(r, size):
    out = [r.choice("ab") for _ in range(size)]
    for _ in range(r.randrange(4)):
        unit = [r.choice("abc") for _ in range(r.randint(1, 20))]
        at = r.randint(0, len(out))
        out[at:at] = [unit[i % len(unit)] for i in range(r.randint(len(unit), 8 * len(unit)))]
    return out


def test_runs_equal_brute_force(spark):
    r = random.Random(5)
    texts = AWKWARD[:4] + AWKWARD[6:] + [" ".join(looped(r, r.choice([0, 5, 40, 90]))) for _ in range(150)]
    got = {x.doc_id: x for x in periodic.with_runs(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        runs = brute_runs(words)
        assert [(x.start, x.length, x.period) for x in got[i].runs] == runs
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert got[i].collapsed.encode() == b" ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_of_long_loops_and_awkward_rows(spark):
    out = periodic.with_runs(docs_of(spark, AWKWARD))
    assert out.columns == ["doc_id", "text", "start", "word", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(AWKWARD) + 2 and sum(x.doc_id is None for x in rows) == 2
    got = {x.doc_id: x for x in rows}
    assert [tuple(x) for x in got[4].runs] == [(0, 3000, 1)] and got[4].collapsed == "a"
    assert [tuple(x) for x in got[5].runs] == [(0, 1500, 3)] and got[5].collapsed == "x y z"
    assert got[0].runs == [] and got[0].collapsed == "" and got[2].collapsed == ""
    r = random.Random(1)
    unit = [r.randrange(3) for _ in range(997)]                # a long period, and a double De Bruijn word in which all short grams recur
    assert periodic.runs_of(np.array([7, *unit * 4, 8])) == brute_runs([7, *unit * 4, 8])
    assert periodic.with_runs(docs_of(spark, []).where("doc_id > 0")).count() == 0


# --- spelling variants ---

def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def edited(r, word, letters):
    i, c = r.randrange(len(word)), r.choice(letters)
    return r.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]])


@pytest.mark.parametrize("part, few, states", [(8000, 4, 1 << 17), (40, 1, 64)])
def test_variants_equal_brute_force(spark, monkeypatch, part, few, states):
    for name, value in (("PART", part), ("FEW", few), ("STATES", states)):
        monkeypatch.setattr(variants, name, value)
    r, letters = random.Random(8), "abcdeéÿz"
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(120)} | {"a" * 40, "a" * 41, "a" * 39 + "b", "aabbcc", "ccbbaa", "ababcc"}
    for _ in range(3):
        words |= {edited(r, w, letters) for w in sorted(words) if r.random() < 0.5}
    counts = {w: r.choice([3, 3, 6, 7, 14, 30, 100]) for w in sorted(words)}
    got = {x.word: x for x in variants.with_forms(spark.createDataFrame(list(counts.items()), "word string, n int")).collect()}
    assert set(got) == set(counts)
    forms = {}
    for w, n in counts.items():
        near = [v for v in counts if brute_near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if near and counts[best] >= 2 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(near), forms[w], counts[best] if forms[w] else None)
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        assert got[w].root == root
    assert any(forms.values()) and any(forms.get(f) for f in forms.values())


def test_words_and_dropped_letters(spark):
    texts = AWKWARD + ["Straße-ÉCLAIR naïve ÉCLAIRS×x 12", "hello hello Hello help", "hello"]
    docs = docs_of(spark, texts)
    found = variants.words(docs)
    import re
    want = Counter()
    for key, text in [*enumerate(texts), (None, "no id at all"), (None, "no id at all")]:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            want[key, re.sub("[A-Z]", lambda m: m.group().lower(), w)] += 1
    assert Counter(map(tuple, found.collect())) == want
    lost = Counter()
    for (key, w), n in want.items():
        h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
        lost[w[:h % len(w)] + w[h % len(w) + 1:] if h % 3 == 0 else w] += n
    got = variants.dropped_letters(found, one_in=3).groupBy("word").count().collect()
    assert {x["word"]: x["count"] for x in got} == dict(lost)
    assert {x.word: x.n for x in variants.counted(found).collect()} == {"hello": 4}
    empty = variants.with_forms(variants.counted(variants.words(docs.where("doc_id < 0"))))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# --- packing ---

def test_ids_equal_the_tokenizers_on_any_text():
    """Both engines cut at the same classes of characters: every tenth code point and all white space, in seven places."""
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    ids = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    points = [chr(c) for c in range(0x110000) if (c % 10 == 7 or chr(c).isspace()) and not 0xD800 <= c < 0xE000]
    r = random.Random(2)
    bits = ["a", " ", "  ", "\n", "\t", "'s", "don't", "é", "　", "中文", "3", ".", "\x85", "\xa0", "<|endoftext|>", "\r\n", "'", "​", "😀"]
    texts = [f"a{c}a 1{c}1 .{c}. {c}  {c} \n{c}'s" for c in points] + ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for i in range(0, len(texts), 5000):
        for text, e in zip(texts[i:i + 5000], other.encode_batch(texts[i:i + 5000], add_special_tokens=False)):
            assert ids(text) == np.array(e.ids, "<u4").tobytes(), text


@pytest.mark.parametrize("windows, merged", [(32, 2048), (2, 3)])
def test_packing_is_an_exact_cover_without_padding(spark, monkeypatch, windows, merged):
    monkeypatch.setattr(packing, "MERGED", merged)
    r = random.Random(4)
    texts = AWKWARD + [" ".join(r.choice(["word", "kalo", "mirter", "x"]) for _ in range(r.choice([1, 5, 60, 400]))) for _ in range(60)]
    docs = docs_of(spark, texts).repartition(7)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids_of, pieces = packing.encoder(path), packing.pack(docs, path, capacity=64, windows=windows)
    assert pieces.columns == ["doc_id", "_start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] or pieces.columns[1] == "start"
    rows = pieces.collect()
    by, seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
        seq[x.sequence_id].append(x)
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length > 0
    for i, text in enumerate(texts):
        whole, at = ids_of(text or "") + b"\0\0\0\0", 0
        for x in sorted(by[i], key=lambda x: x.start):
            assert x.start * 4 == at and x.doc_tokens * 4 == len(whole) and x.ids == whole[at:at + 4 * x.length]
            at += 4 * x.length
        assert at == len(whole)
    assert sum(x.length for x in by[None]) == 2 * len(ids_of("no id at all") + b"\0\0\0\0") // 4
    sizes = []
    for parts in seq.values():
        at = 0
        for x in sorted(parts, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        sizes.append(at)
    short = [s for s in sizes if s != 64]
    assert max(sizes) == 64 and len(set(short)) == len(short) and all(s & (s - 1) == 0 for s in short)
    joined = {x.sequence_id: x.ids for x in packing.sequences(pieces).collect()}
    assert joined == {k: b"".join(x.ids for x in sorted(v, key=lambda x: x.offset)) for k, v in seq.items()}


def test_packing_keeps_short_texts_whole_where_they_fit(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(200)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, path, keep_ids=False)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() - 200 <= pieces.select("sequence_id").distinct().count()
    assert packing.pack(docs.where("doc_id < 0"), path).count() == 0


def test_queries_keep_their_contract(spark, tmp_path):
    """Every row of the three queries on a small folder, with the names, order and types of the contract."""
    from pingframe.llm.queries import QUERIES

    r = random.Random(6)
    texts = AWKWARD + ["".join(r.choice(["kalo ", "kallo ", "mirter ", "Mirtera "]) for _ in range(60)) for _ in range(40)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {
        "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
        "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op13_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    }
    rows = {}
    for name, kinds in want.items():
        df = QUERIES[name](spark, str(tmp_path))
        assert ", ".join(map(" ".join, df.dtypes)) == kinds
        rows[name] = df.collect()
    import hashlib
    import re
    for x in rows["op11_periodic_runs"]:
        text = "no id at all" if x.doc_id is None else texts[x.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        top = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=(None, None, None))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert x.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert len(rows["op11_periodic_runs"]) == len(texts) + 2
