"""Columns of the registered queries, ties between equal cosines, short benchmark items, clashing names in a mix."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.llm import ann, decontam, mixing
from pingframe.llm.queries import QUERIES

FIRST = {
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_archives": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("name", FIRST)
def test_query_has_its_columns_first(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(map(" ".join, df.dtypes)).startswith(FIRST[name])


def test_equal_cosines_go_to_the_smaller_ids(spark):
    base = np.array([0.3, -1.2, 0.5, 2.0, 0.1, 0.7, -0.4, 1.1])
    rows = [(i, (base * 2.0 ** (i % 9)).tolist()) for i in range(40)] + [(100 + i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(30)] + [(7, base.tolist())] * 2
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[20]] == [0, 1, 2, 3, 4] and all(s == got[0][0][1] for _, s in got[0])


def test_short_items_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([(0, "Say: what is 7 x 8?  Then go"), (1, "somewhat is 7 x 8"), (2, "WHAT is... 7-x-8"), (3, "what is 7 x 88"), (4, None), (5, "x"), (6, "what was 7 x 8")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "What is 7 x 8?"), (2, "?!"), (3, ""), (4, None), (5, "x"), (1, "What is 7 x 8?"), (6, "is 7 x 8 then")], "item_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in decontam.with_matches(docs, items).collect()}
    assert got == {0: [(1, 0, 13), (5, 0, 1), (6, 0, 13)], 1: [(5, 0, 1)], 2: [(1, 0, 13), (5, 0, 1)], 3: [(5, 0, 1)], 4: [], 5: [(5, 0, 1)], 6: [(5, 0, 1)]}
    assert sorted(r.doc_id for r in decontam.decontaminated(docs.where("doc_id <> 5"), items.where("item_id = 1")).collect()) == [1, 3, 4, 6]
    blocks = decontam.with_matches(docs, items, block_bytes=1)                # an item in each block
    assert {r.doc_id: [tuple(m) for m in r.matches] for r in blocks.collect()} == got


def test_the_mix_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t", f"z{i}", "x", 1.5) for i in range(30)], "doc_id long, text string, source string, Size string, target string, times double")
    out = mixing.mixed_documents(docs)
    assert out.dtypes == docs.dtypes and out.count() > 0
    assert out.where("Size <> concat('z', doc_id) OR target <> 'x' OR times <> 1.5").count() == 0


def test_common_passages_and_groups_change_no_link(spark, monkeypatch):
    """A passage in every text and a group of near copies: the same groups for any sample, any list of common shingles and any radius."""
    import random

    from pingframe.llm import simhash

    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(25):
        texts.append([word() for _ in range(r.randint(30, 200))] + passage)
    for n in (90, 200):
        base = [word() for _ in range(n)]
        for _ in range(30):
            t = list(base)
            for i in r.sample(range(n), r.choice([0, 1, 2, 3])):
                t[i] = word()
            texts.append(t)
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in texts]
    label = list(range(len(texts)))
    for _ in range(6):
        for i in range(len(texts)):
            for j in range(i):
                if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for common, radius in ((1 << 16, 7), (0, 3), (10, 1)):
        monkeypatch.setattr(simhash.common_shingles, "__defaults__", ("text", 4096, common))
        monkeypatch.setattr(simhash.similar, "__defaults__", (radius,))
        assert sorted(x.doc_id for x in simhash.keep_one_similar(docs).collect()) == sorted(set(label))


def test_texts_just_too_different_do_not_meet(spark):
    """Sets with most of one base in common and rare shingles of their own are no candidates; whatever is similar is one."""
    import numpy as np

    from pingframe.llm import simhash

    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    base = np.unique(fresh(150))
    apart = [np.unique(np.r_[base[24:], fresh(24)]) for _ in range(60)]
    alike = [np.unique(np.r_[base[k:], fresh(k)]) for k in r.integers(0, 14, 20)]
    sets = apart + alike
    rows = [(int(x), p, i, len(s), i) for i, s in enumerate(sets) for p, x in enumerate(simhash._head(s, base).tolist())]
    heads = spark.createDataFrame(rows, "x long, p int, id long, n int, g long")
    met = {(a.src, a.dst) for a in simhash._met(heads).collect()}
    true = {(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert true and true <= met and not [x for x in met if max(x) < len(apart)]
    marked = spark.createDataFrame([(i, len(s), simhash._parity(s).tolist()) for i, s in enumerate(sets)], "id long, n int, parity array<long>")
    every = spark.createDataFrame([(i, j) for j in range(len(sets)) for i in range(j)], "src long, dst long")
    left = {(a.src, a.dst) for a in simhash._plausible(every, marked).collect()}
    assert true <= left and len(left) < every.count() / 2


def test_stored_tables_leave_no_shuffle_files(spark):
    from pingframe.llm import common

    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, setting = known.size(), spark.conf.get(common.SHUFFLE_CLEANUP, "false")
    out = common.stored(spark.range(1000).repartition(7, "id"), "test")
    assert known.size() <= before and out.count() == 1000 and spark.conf.get(common.SHUFFLE_CLEANUP, "false") == setting
