"""Operators of the training-data subpackage against brute force, round trips, held-out accuracy, and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pingframe.llm import ann, chat, decontam, lm, mixing, pii, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, score string, _fp string"


def docs_of(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", 0, 7, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(r, n, words="ka lo mi ter un vos wex yal zor".split()):
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


AWKWARD = [None, "", " \n\t", "one", "one two", "Ünïcödé 　 x", "a " * 30000, "same text here now", "same text here now"]


# --- chat ---

def test_chat_prefix_masks_and_awkward_rows(spark):
    rows = [(0, 0, "user", "hi", 1), (0, 1, "assistant", "yo", 1), (0, 2, "user", "bye", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "no", 1),
            (2, 0, None, None, 1), (3, None, "user", "", 1), (3, None, "user", "", 1), (None, 0, "user", "lost", 1), (4, 0, "assistant", "yo", 1), (5, 0, "assistant", "yo", 1)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    out = {r.conv_id: r for r in chat.format_preferences(chat.swapped_replies(t)).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 5}
    a = out[0]
    assert a.n_prompt == 1 and a.prompt == "<|user|>\nhi<|end|>\n"
    assert [a.chosen_completion[s["from"]:s["to"]] for s in a.chosen_mask] == ["yo<|end|>"]
    assert [a.rejected_completion[s["from"]:s["to"]] for s in a.rejected_mask] == ["no<|end|>"]
    assert a.chosen_completion.endswith("bye<|end|>\n")
    assert out[4].n_prompt == 1 and out[4].chosen_completion == out[4].rejected_completion == ""
    assert out[2].rejected_completion == "" and out[3].chosen_completion.count("<|user|>") == 2
    assert chat.format_preferences(chat.swapped_replies(t.limit(0))).count() == 0


# --- simhash ---

def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash_equals_brute_force(spark):
    r = random.Random(3)
    base = [prose(r, 200) for _ in range(12)]
    texts = AWKWARD + base + [b + " " + prose(r, 1) for b in base for _ in range(3)] + [prose(r, n) for n in range(20)]
    got = {x.doc_id: x for x in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)
    kept = simhash.keep_one(docs_of(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(brute_components(fps))) and set(kept[0].asDict()) == set(docs_of(spark, [""]).columns)


@pytest.mark.parametrize("tile", [4, 64, 4096])
def test_links_connect_all_close_fingerprints(spark, tile):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    hot = [0xABCD << 48 | r.getrandbits(14) for _ in range(200)]                 # one block that many share
    fps = sorted(fps | set(hot))
    t = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = simhash.links(t, 3, tile).collect()
    seen = {f: f for f in fps}

    def root(x):
        while seen[x] != x:
            x = seen[x]
        return x

    for e in got:
        a, b = int(np.int64(e.src).astype(np.uint64)), int(np.int64(e.dst).astype(np.uint64))
        assert bin(a ^ b).count("1") <= 3
        seen[max(root(a), root(b))] = min(root(a), root(b))
    want = brute_components(fps)
    assert [fps.index(root(f)) for f in fps] == want


def test_simhash_nulls_repeats_and_empty(spark):
    t = docs_of(spark, ["a b c d", "a b c d", "a b c d", None], ids=[5, 5, None, None])
    out = simhash.near_duplicates(t).collect()
    assert len(out) == 4 and sorted((x.doc_id or -1, x.component_id or -1) for x in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert len(simhash.keep_one(t).collect()) == 2
    assert simhash.near_duplicates(t.limit(0)).count() == 0 and simhash.keep_one(t.limit(0)).count() == 0


def test_pipeline_stage_keeps_one_of_similar_texts(spark):
    import corpus_pipeline

    r = random.Random(12)
    base = [prose(r, n) for n in (12, 40, 60, 200, 300)]
    texts = AWKWARD[:3] + base
    for b in base:
        for changed in (1, 2, 4, 8):
            words = b.split()
            for i in r.sample(range(len(words)), changed):
                words[i] = "other"
            texts.append(" ".join(words))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts), "").collect()
    assert 0 < len(set(label)) - 1 < len(texts) - 5
    assert sorted(x.doc_id for x in kept) == sorted(set(label)) and set(kept[0].asDict()) == set(docs_of(spark, [""]).columns)
    assert corpus_pipeline.drop_near_copies(spark, docs_of(spark, [""]).limit(0), "").count() == 0


# --- decontamination ---

def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_matches_equal_brute_force(spark):
    r = random.Random(9)
    items = [prose(r, 12) for _ in range(6)]
    texts = list(AWKWARD)
    for item in items:
        for edits in range(5):
            s = list(item)
            for _ in range(edits):
                at = r.randrange(len(s))
                s[at:at + 1] = r.choice([[], [r.choice("abc")], [s[at], "q"]])
            texts.append(prose(r, 30) + " " + "".join(s).upper() + "!! " + prose(r, 10))
    bench = spark.createDataFrame([*enumerate(items), (6, None), (None, items[0]), (7, "short"), (0, items[0])], "item_id long, text string")
    got = {x.doc_id: {m.item_id: m.distance for m in x.matches} for x in decontam.with_matches(docs_of(spark, texts), bench).collect()}
    for d, t in enumerate(texts):
        f = decontam.folded(t or "")
        want = {}
        for i, item in enumerate(map(decontam.folded, items)):
            k = int(len(item) * decontam.BUDGET)
            if len(f) < 5000 and brute_distance(item, f) <= k:
                want[i] = brute_distance(item, f)
        assert got[d] == want, d
    blocks = decontam.with_matches(docs_of(spark, texts), bench, block_bytes=100).collect()
    assert {x.doc_id: {m.item_id: m.distance for m in x.matches} for x in blocks} == got
    clean = decontam.decontaminated(docs_of(spark, texts), bench)
    assert {x.doc_id for x in clean.collect()} == {d for d, m in got.items() if not m} and clean.columns == docs_of(spark, [""]).columns
    assert decontam.decontaminated(docs_of(spark, texts), bench.limit(0)).count() == len(texts)


# --- sharding ---

@pytest.mark.parametrize("step", [1 << 30, 200])
def test_shards_are_contiguous_balanced_and_gapless(spark, step):
    r = random.Random(1)
    texts = AWKWARD + ["x" * r.randrange(400) for _ in range(300)]
    ids = [None, None] + [7] * 100 + sorted(r.randrange(10**12) for _ in range(len(texts) - 102))
    out = sharding.balanced_shards(docs_of(spark, texts, ids=ids), 10, step_bytes=step).collect()
    assert len(out) == len(texts)
    size = lambda x: len((x.text or "").encode()) + 16
    total, bytes_, slots, span = sum(map(size, out)), Counter(), defaultdict(list), defaultdict(list)
    for x in out:
        bytes_[x.shard] += size(x)
        slots[x.shard].append(x.slot)
        span[x.shard].append(-1 if x.doc_id is None else x.doc_id)
    largest = max(map(size, out))
    assert all(abs(b - total / 10) <= largest for s, b in bytes_.items() if largest < total / 10 or abs(b - largest) > total / 10)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    shards = sorted(span)
    assert all(max(span[a]) <= min(span[b]) for a, b in zip(shards, shards[1:]))
    assert sharding.balanced_shards(docs_of(spark, [""]).limit(0), 10).count() == 0


# --- mixing ---

def test_fit_counts_reaches_the_best_subset_sum():
    r = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(0, 60), 5)))
        counts = np.array([r.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = r.randint(0, total)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {x + n * k for x in reach for k in range(c + 1)}
        got = mixing.fit_counts(lengths, counts, budget)
        assert (got <= counts).all() and int((got * lengths).sum()) == max(x for x in reach if x <= budget)


def test_mix_targets_budgets_and_copies(spark):
    r = random.Random(4)
    texts = [t for t in AWKWARD if len(t or "") < 1000] + [prose(r, r.randint(1, 60)) for _ in range(800)]      # a document of half its source would leave no fit
    sources = [r.choice(["a", "a", "a", "b", "c", "é", None]) for _ in texts]
    rows = mixing.mix(docs_of(spark, texts, sources)).collect()
    again = mixing.mix(docs_of(spark, texts, sources).repartition(7)).collect()
    assert {x.doc_id: x.times for x in rows} == {x.doc_id: x.times for x in again} and len(rows) == len(texts)
    size, taken, target = Counter(), Counter(), {}
    for x in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        assert int(x["size"]) == n and 0 <= x.times <= 3
        size[x.source] += n
        taken[x.source] += n * x.times
        target[x.source] = x.target
    names = sorted([s for s in size if s is not None], key=lambda s: [ord(c) for c in s]) + [None]
    weight, cap, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3 * size[s] for s in names}, sum(size.values())
    want, free, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = float(cap[s])
            left -= cap[s]
            free.remove(s)
    assert all(abs(target[s] - want[s]) < 1e-6 * total for s in names)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mixing.repeated(mixing.mix(docs_of(spark, texts, sources))).count() == sum(x.times for x in rows)
    assert mixing.mix(docs_of(spark, [""]).limit(0)).count() == 0


# --- language model ---

def test_scores_base_and_probability(spark):
    r = random.Random(8)
    texts = AWKWARD + [prose(r, r.randint(1, 80)) for _ in range(300)]
    out = {x.doc_id: x for x in lm.score(docs_of(spark, texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    words = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    c = Counter(w for i, t in enumerate(words) if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(words):
        x = out[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert abs(x.base_score - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * max(1, len(t))
        assert x.score < 0 and x.bits_per_byte >= 0
    shuffled = "".join(r.sample(texts[-1], len(texts[-1])))
    m = lm.train(docs_of(spark, texts))[0]()
    assert m.log10s(shuffled.encode().split()).mean() < m.log10s(texts[-1].encode().split()).mean()
    assert lm.score(docs_of(spark, [""]).limit(0)).count() == 0
    twice = lm.score(docs_of(spark, ["a b", "a b"], ids=[None, None])).collect()
    assert len(twice) == 2 and twice[0].base_score == twice[1].base_score


def test_words_are_predicted_from_the_words_before(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice(["red fox", "blue owl", "green elk"]) for _ in range(60)) for _ in range(200)]      # the second word follows from the first
    m = lm.train(docs_of(spark, texts))[0]()
    log = m.log10s(b"red fox blue owl green elk red owl".split())
    assert log[1::2][:3].min() > -0.1 and log[7] < -1
    assert m.log10s([b"fox"], past=lm.pasts(lm._digests([b"red", b"fox"]))[:, 1:])[0] == pytest.approx(log[1])


def test_code_tree_and_word_probabilities_sum_to_one():
    tree = lm.code_tree(np.arange(256.0))
    assert abs(sum(2.0 ** -n for n in tree[0]) - 1) < 1e-12
    m = lm.Mixer(tree, *([np.zeros(1 << b, kind) for b in lm.SLOT_BITS] for kind in (np.int16, np.uint8, np.uint8)))
    r = np.random.default_rng(0)
    for s, k in zip(m.stretch, m.sure):
        s[:] = r.integers(-600, 600, len(s))
    first = [m.log10s([bytes([b])])[0] for b in range(256) if b not in (0x20, 0x0A)]
    assert sum(10.0 ** x for x in first) < 1
    logs = lm.adapted(np.array([3, 3, 5, -1]), np.log10([0.1, 0.1, 0.2, 0.5]), np.array([0]))
    mean = np.mean([0.1 * ((1 - c) * 0.1 + c * 1) * (1 - c) * 0.2 * (1 - c) * 0.5 for c in lm.CACHE])
    assert abs(10.0 ** logs[0] - mean) < 1e-12


# --- nearest neighbours ---

def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 24))
    x = (centres[r.integers(0, 40, 1500)] + 0.5 * r.standard_normal((1500, 24))).astype(np.float32)
    x[1200:] = x[100]                                                             # a hot vector
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(2000, None, "e"), (2050, [0.0] * 24, "e"), (2100, [float("nan")] * 24, "e"), (None, [1.0] * 24, "e"),
                                                              (2150, [1.0] * 7, "e"), (2151, [1.0] * 7, "e"), (2152, [None] * 7, "e"), (2200, [], "e")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = defaultdict(list)
    for y in ann.nearest(t, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[y.query_id].append((y.vec_id, y.score))
    assert set(got) == {*range(0, 1500, 50), 2150} and [v for v, _ in got[2150]] == [2151]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({v for v, _ in got[q]} & set(want))
        assert len(got[q]) == 5 and all(abs(c - s[v]) < 1e-12 for v, c in got[q])
    assert hits >= 0.9 * 5 * 30
    assert [v for v, _ in got[1200]] == [100, 1201, 1202, 1203, 1204]
    assert ann.nearest(t.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(t.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2


# --- personal data ---

def brute_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [(2, m.start(), m.end())] if 13 <= len(d) <= 19 and pii.passes_luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(3, m.start(), m.end())] if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15 else []
    return sorted(out)


def personal(r):
    return r.choice([f"{prose(r, 1)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(0, 255)) for _ in range(4)),
                     f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", "4111 1111 1111 1111"])


def test_patterns_equal_plain_regular_expressions():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("12 0@a.b-+(%5255.\n") for _ in range(r.randint(0, 40)))
        assert sorted(pii.pattern_spans(t)) == brute_spans(t), t


def test_tagger_learns_spans_and_keeps_the_patterns(spark):
    r = random.Random(7)
    make = lambda: " ".join(x for _ in range(6) for x in (prose(r, 8), personal(r)))
    texts = [make() for _ in range(150)]
    x, y = pii.training_windows(texts[:120])
    model = pii.Tagger().fit(x, y, 6)
    x, y = pii.training_windows(texts[120:], seed=5)
    tags = model.best_tags(model.emissions(x))
    assert (tags == y)[y > 0].mean() > 0.9 and (tags == y)[y == 0].mean() > 0.97          # held-out documents
    all_ = AWKWARD + texts[120:] + ["no digits at all"]
    out = {z.doc_id: z.pii for z in pii.with_spans(docs_of(spark, all_), model).collect()}
    for i, t in enumerate(all_):
        base = brute_spans(t or "")
        spelled = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert out[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(out[i].spans.split(",")) and out[i].n_email == sum(k == 0 for k, _, _ in base)
    assert pii.train(docs_of(spark, ["nothing here"])) is None and pii.find_all(["a@b.cd"], None)[0].base == [(0, 0, 6)]


# --- toxicity ---

def test_classifier_on_held_out_rows(spark):
    r = random.Random(12)
    bad = ["grumpus", "snarlek", "vilebot"]
    texts, labels = list(AWKWARD), []
    for i in range(600):
        toxic = r.random() < 0.3
        words = prose(r, r.randint(20, 120)).split()
        for _ in range(r.randint(1, 3) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        labels.append((len(texts), int(toxic)))
        texts.append(" ".join(words))
    lab = spark.createDataFrame([*labels, labels[0], (None, 1), (0, None)], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    model = toxicity.train(docs, lab)
    out = {x.doc_id: x.score for x in toxicity.with_scores(docs, model).collect()}
    assert len(out) == len(texts) and all(0 <= s <= 1 for s in out.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == y for i, y in held]) > 0.95
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, s in out.items() if s < 0.5}
    assert toxicity.train(docs, lab.limit(0)).weights == {} and toxicity.with_scores(docs.limit(0), model).count() == 0
    again = toxicity.train(docs.repartition(5), lab)
    assert again == model


# --- archives ---

def test_archives_round_trip_and_are_the_same_again(spark, tmp_path):
    r = random.Random(21)
    big = prose(r, 400)
    rows = [(i, f"http://x/{i}", prose(r, r.randint(1, 300)), "q") for i in range(120)] + [(200 + i, "http://y", big, "q") for i in range(30)]
    rows += [(300, "http://a\r\nX: 1", None, "q"), (301, None, "", "q"), (None, "http://n", big, "q"), (302, "http://r", big, "q"), (302, "http://r", big, "q"), (303, "s", "tiny", "q"), (304, "s", "tiny", "q")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string, shard string")
    sums = []
    for n, parts in enumerate((3, 7)):
        folder = f"file://{tmp_path}/{n}"
        m = warc.write_archives(t.repartition(parts), folder, roll_bytes=4000, shard_bytes=40000)
        sums.append(sorted((x.file, x.sha1, x.records) for x in m.collect()))
        assert sum(x[2] for x in sums[-1]) == len(rows) and len(sums[-1]) > 5
    assert sums[0] == sums[1]
    got = Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_archives(spark, folder).collect())
    want = Counter()
    for i, _, html, _ in rows:
        b = (html or "").encode()
        again = len(b) >= 1000 and html == big
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 302 if again else None)] += 1
    want[(302, len(big), hashlib.sha1(big.encode()).hexdigest(), "revisit", 302)] -= 1
    want[(302, len(big), hashlib.sha1(big.encode()).hexdigest(), "response", None)] += 1
    assert got == +want
    first = next(p for p in tmp_path.glob("1/part-*"))
    first.write_bytes(first.read_bytes()[:-9])
    with pytest.raises(OSError):
        warc.read_archives(spark, folder)
    warc.write_archives(t.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
