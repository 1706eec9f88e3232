"""Row filters, contact questions, top-k and validity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import ColumnLike, col, lookup
from .scale import ranked

DIMENSIONS = {"length": "length_m", "height": "height_m", "depth": "depth_m"}


def contact_filter(survey: str | None = None, cls: str | None = None, min_conf: float | None = None,
                   min_sev: float | None = None, review: str | None = None, survey_like: str | None = None) -> Column:
    """Conjunction of the given conditions on stored columns, so Parquet can prune."""
    cond = F.lit(True)
    if survey is not None:
        cond = cond & (F.col("survey") == survey)
    if survey_like is not None:
        cond = cond & F.contains(F.lower("survey"), F.lit(survey_like.lower()))
    if cls is not None:
        cond = cond & (F.col("cls") == cls)
    if min_conf is not None:
        cond = cond & (F.col("confidence") >= min_conf)
    if min_sev is not None:
        cond = cond & (F.col("severity") >= min_sev)
    if review is not None:
        cond = cond & (F.col("review") == review)
    return cond


def query_contacts(contacts: DataFrame, limit: int | None = 500, **where) -> DataFrame:
    """Most severe first; ties by id.  `limit` is a top-k, run as TakeOrderedAndProject."""
    out = contacts.where(contact_filter(**where)).orderBy(F.desc("severity"), "id")
    return out if limit is None else out.limit(limit)


def top_contacts(contacts: DataFrame, n: int = 5, by: str = "severity", where: Column | None = None) -> DataFrame:
    out = contacts if where is None else contacts.where(where)
    return out.orderBy(F.desc(by), "id").limit(n)


def dim_filter(field: str, lo: float | None = None, hi: float | None = None, inclusive: bool = False) -> Column:
    """Range predicate on a measured dimension; an unmeasured one never matches, also under NOT."""
    c, cond = F.col(DIMENSIONS.get(field, field)), F.lit(True)
    if lo is not None:
        cond = cond & ((c >= lo) if inclusive else (c > lo))
    if hi is not None:
        cond = cond & ((c <= hi) if inclusive else (c < hi))
    return F.coalesce(cond & c.isNotNull(), F.lit(False))


def class_of_word(word: ColumnLike) -> Column:
    """Class meant by a word or phrase (case-insensitive); NULL when unknown."""
    return lookup(K.CLASS_SYNONYMS, F.lower(F.trim(col(word))))


def find_class(text: ColumnLike) -> Column:
    """First class whose phrase occurs as whole words in a text, longest phrase first.

    The class names themselves count, with spaces for underscores.
    """
    phrases = {**K.CLASS_SYNONYMS, **{c.replace("_", " "): c for c in K.REPORTABLE}}
    t, expr = F.lower(col(text)), None
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        hit = F.regexp_like(t, F.lit(rf"\b{phrase}s?\b"))
        expr = F.when(hit, F.lit(phrases[phrase])) if expr is None else expr.when(hit, F.lit(phrases[phrase]))
    return expr


def severity_word_threshold(word: ColumnLike) -> Column:
    return lookup(K.SEVERITY_WORDS, F.lower(col(word)))


def is_reportable(cls: ColumnLike) -> Column:
    return F.coalesce(col(cls).isin(*K.REPORTABLE), F.lit(False))


def slice_pings(df: DataFrame, start: int, stop: int, ping: str = "ping") -> DataFrame:
    """Pings [start, stop) renumbered from 0; `ping_offset` keeps the way back."""
    return (df.where((F.col(ping) >= start) & (F.col(ping) < stop))
            .withColumn("ping_offset", F.lit(start)).withColumn(ping, F.col(ping) - start))


def blank_water_column(samples: ColumnLike, first_return: ColumnLike, fill: float = 0.0) -> Column:
    fr = col(first_return)
    return F.transform(col(samples), lambda v, i: F.when(i < fr, F.lit(float(fill))).otherwise(v))


def conditioning_route(meta: DataFrame) -> DataFrame:
    """Which stages a survey needs: mosaics skip tracking and slant correction, normalised imagery skips gain."""
    mosaic = F.coalesce(F.col("ground_range"), F.lit(False))
    return meta.withColumns({
        "needs_tracking": ~mosaic, "needs_slant": ~mosaic,
        "needs_gain": ~mosaic & ~F.coalesce(F.col("gain_normalized"), F.lit(False))})


def mosaic_ground_res(*candidates: ColumnLike, fallback: float = 1.0) -> Column:
    """First usable metres-per-column of a preference chain; 0 and NULL are unusable."""
    usable = [F.when(col(c) > 0, col(c).cast("double")) for c in candidates]
    return F.coalesce(*usable, F.lit(fallback))


def decimate(df: DataFrame, n_rows: ColumnLike, max_rows: int, ping: str = "ping") -> DataFrame:
    """Every k-th ping so that at most `max_rows` remain (quick-look sampling)."""
    step = F.greatest(F.ceil(col(n_rows) / F.lit(max_rows)), F.lit(1))
    return df.where(F.pmod(F.col(ping), step) == 0)


def upload_violations(altitude: ColumnLike, slant_range: ColumnLike, lat: ColumnLike, lon: ColumnLike,
                      layout: ColumnLike) -> Column:
    """Everything wrong with a declared geometry; an empty array means usable."""
    a, r, la, lo = col(altitude), col(slant_range), col(lat), col(lon)
    checks = [
        (a.isNull() | r.isNull(), "geometry required"),
        ((a <= 0) | (r <= 0), "geometry must be positive"),
        ((la < -90) | (la > 90), "lat outside [-90, 90]"),
        ((lo < -180) | (lo > 180), "lon outside [-180, 180]"),
        (la.isNull() != lo.isNull(), "lat and lon go together"),
        (r <= a, "range must exceed altitude"),
        (~col(layout).isin("combined", "single"), "unknown layout"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]))


def slant_violations(altitude: ColumnLike, ground_range: ColumnLike) -> Column:
    a = col(altitude)
    bad_alt = a.isNull() | F.isnan(a.cast("double")) | (a <= 0)
    return F.array_compact(F.array(
        F.when(bad_alt, F.lit("altitude must be finite and positive")),
        F.when(F.coalesce(col(ground_range), F.lit(False)), F.lit("already ground range"))))


def quarantine(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their `violations`)."""
    checked = df.withColumn("violations", violations)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def structural_faults(traces: DataFrame, nav: DataFrame) -> DataFrame:
    """Pings that break the survey's shape: a side missing, no nav record, or nav without traces."""
    per_ping = traces.groupBy("survey", "ping").agg(
        F.count_if(F.col("side") == "port").alias("n_port"),
        F.count_if(F.col("side") == "starboard").alias("n_starboard"))
    nav_rows = nav.groupBy("survey", "ping").agg(F.count(F.lit(1)).alias("n_nav"))
    both = per_ping.join(nav_rows, ["survey", "ping"], "full_outer").na.fill(0, ["n_port", "n_starboard", "n_nav"])
    fault = (F.when(F.col("n_nav") == 0, F.lit("no nav record"))
             .when(F.col("n_nav") > 1, F.lit("several nav records"))
             .when((F.col("n_port") == 0) & (F.col("n_starboard") == 0), F.lit("no traces"))
             .when(F.col("n_port") != F.col("n_starboard"), F.lit("ping-count mismatch"))
             .when(F.col("n_port") > 1, F.lit("several traces")))
    return both.withColumn("fault", fault).where(F.col("fault").isNotNull())


def score_floor(df: DataFrame, floor: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= floor)


def blob_filter(min_area: int = 12, max_area: int = 100_000, max_aspect: float = 12.0) -> Column:
    """Area and aspect limits of the classical detector on blob aggregates."""
    aspect = (F.col("ping1") - F.col("ping0") + 1).cast("double") / (F.col("col1") - F.col("col0") + 1)
    return F.col("area").between(min_area, max_area) & (aspect <= max_aspect) & (aspect >= 1.0 / max_aspect)


def anomaly_pixels(df: DataFrame, threshold: ColumnLike, nadir_guard: int = 32) -> DataFrame:
    """Error pixels above threshold and outside the nadir guard (ground columns)."""
    return df.where((F.col("v") > col(threshold)) & (F.col("col") >= nadir_guard))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; the limit is applied on both sides of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def budget_per_tile(blobs: DataFrame, budget: int) -> DataFrame:
    """Strongest candidates per tile; 0 switches the budget off."""
    if budget <= 0:
        return blobs
    return top_per_group(blobs, ["survey", "side", "tile_index"], [F.desc("score"), F.asc("det_id")], budget).drop("rank")


def sorted_contacts(contacts: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    first = F.asc(key) if ascending else F.desc(key)
    return contacts.orderBy(first, "id")


def spread_sample(df: DataFrame, order: Sequence[Column], limit: int, total: int | None = None) -> DataFrame:
    """Evenly spread `limit` rows over the whole ordered corpus (every step-th row)."""
    n = df.count() if total is None else total
    step = max(n // limit, 1)
    picked = ranked(df, [], order, "_rank").where(F.pmod(F.col("_rank") - 1, F.lit(step)) == 0)
    return picked.where((F.col("_rank") - 1) / step < limit).drop("_rank")
