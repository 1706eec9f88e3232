"""Percentiles: the radix search gives the bits of Spark's own percentile, for all probabilities at once."""
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.operators import scale

PROBS = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "med": 0.5, "p75": 0.75, "p995": 0.995, "top": 1.0}


def bits(v):
    return None if v is None else struct.pack("<d", v)


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(5)
    rows = [("normal", float(v)) for v in r.normal(0, 1e3, 2001)] + [("tiny", float(v)) for v in r.normal(0, 1e-300, 300)] + [("one", 3.25)] + [("two", v) for v in (-1.5, 1e308)]
    rows += [("copies", float(v)) for v in r.integers(-3, 4, 5000)] + [("wide", float(s * 10.0 ** e)) for s in (-1, 1) for e in range(-300, 301, 7)] + [("none", None)] * 4
    rows += [("edge", v) for v in (5e-324, -5e-324, 0.0, 1.0, math.inf, -math.inf, None)] + [("near", float(np.nextafter(1.0, 2.0) if i % 3 else 1.0)) for i in range(50)]
    rows += [(None, float(v)) for v in r.uniform(0, 1, 40)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_radix_search_gives_the_bits_of_percentile(spark, values):
    want = {r.g: [bits(r[p]) for p in PROBS] for r in values.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(o) for o, p in PROBS.items()]).collect() if r.g is not None}
    hot = scale.exact_percentiles(values.where("g IS NOT NULL"), ["g"], "v", PROBS, max_group=0)
    assert {r.g: [bits(r[p]) for p in PROBS] for r in hot.collect()} == want
    assert hot.columns == ["g", *PROBS]
    assert {r.g: [bits(r[p]) for p in PROBS] for r in scale.exact_percentiles(values.where("g IS NOT NULL"), ["g"], "v", PROBS).collect()} == want


def test_no_keys_nan_and_negative_zero(spark):
    t = spark.createDataFrame([(float("nan"),), (1.0,), (-0.0,), (0.0,), (None,), (-2.0,)], "v double")
    row = scale.exact_percentiles(t, [], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}, max_group=0).first()
    assert row.low == -2.0 and row.mid == 0.0 and math.isnan(row.top)
    empty = scale.exact_percentiles(t.where("v > 5 AND v < 6"), [], "v", {"mid": 0.5}, max_group=-1).collect()
    assert [r.mid for r in empty] == [None]


def test_rows_written_do_not_depend_on_the_probabilities(spark, values, monkeypatch):
    kept = []
    monkeypatch.setattr(scale, "written", lambda df, real=scale.written: kept.append(out := real(df)) or out)
    for probs in ({"med": 0.5}, PROBS):
        scale.exact_percentiles(values, ["g"], "v", probs, max_group=0).count()
    assert len(kept) == 2 and kept[0].count() == kept[1].count() == values.where("v IS NOT NULL").count()


def test_bits_keep_the_order(spark):
    v = sorted(np.random.default_rng(1).normal(0, 1, 100).tolist() + [0.0, math.inf, -math.inf, 1e-320, -1e-320, 1e308])
    t = spark.createDataFrame([(x,) for x in v], "v double").select("v", scale.ordered_bits("v").alias("b")).select("v", "b", scale.from_ordered_bits("b").alias("w"))
    rows = t.orderBy("b").collect()
    assert [r.v for r in rows] == v and all(bits(r.v) == bits(r.w) for r in rows)
