"""Small Column helpers shared by every module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    """A DOUBLE column from a name, a Column or a number."""
    if isinstance(c, (int, float)):
        return F.lit(float(c))
    return col(c).cast("double")


def half_even(c: ColumnLike, digits: int) -> Column:
    """Round half to even, as the numbers in the reports are rounded."""
    return F.bround(dbl(c), digits)


def nan_to_null(c: ColumnLike) -> Column:
    """No-data is NULL everywhere in this library; convert NaN once at the border."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite_samples(samples: ColumnLike) -> Column:
    """Array of samples with NaN replaced by NULL."""
    return F.transform(col(samples), lambda v: F.when(~F.isnan(v), v.cast("double")))


def clamp(c, lo, hi) -> Column:
    lo = F.lit(lo) if isinstance(lo, (int, float)) else lo
    hi = F.lit(hi) if isinstance(hi, (int, float)) else hi
    return F.greatest(F.least(c, hi), lo)


def const_map(mapping: dict) -> Column:
    """A literal map from a configuration table (tens of entries)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(mapping: dict, key: ColumnLike, default=None) -> Column:
    """Configuration lookup as a CASE chain: foldable, codegen-friendly, no shuffle."""
    key = col(key)
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    if isinstance(default, Column):
        return expr.otherwise(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr
