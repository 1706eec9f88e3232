"""Text built from columns: filter notes, briefing lines, evidence cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col, half_even


def describe_range(field: str, lo: float | None = None, hi: float | None = None, inclusive: bool = False) -> str:
    if lo is not None and hi is not None:
        return f"{field} {lo:g}-{hi:g} m"
    if lo is not None:
        return f"{field} {'>=' if inclusive else '>'} {lo:g} m"
    return f"{field} {'<=' if inclusive else '<'} {hi:g} m"


def top_contact_line(rank: ColumnLike, cid: ColumnLike, cls: ColumnLike, severity: ColumnLike,
                     lat: ColumnLike, lon: ColumnLike) -> Column:
    return F.format_string("%d. %s — %s, severity %s, at %.5f, %.5f", col(rank), col(cid), col(cls),
                           col(severity).cast("string"), col(lat), col(lon))


def answer_line(cid: ColumnLike, cls: ColumnLike, severity: ColumnLike, confidence: ColumnLike) -> Column:
    return F.format_string("%s: %s (severity %s, confidence %s%%)", col(cid), col(cls),
                           col(severity).cast("string"), col(confidence).cast("string"))


def brain_letters(brain: ColumnLike) -> Column:
    """Distinct letters of a provenance string, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(col(brain), ""), lambda c: c != "")))


def evidence_cues(analysis: ColumnLike, gate: ColumnLike, brain: ColumnLike, score: ColumnLike,
                  confidence: ColumnLike, verifier_p: ColumnLike, pings: ColumnLike) -> Column:
    """JSON evidence row of one verified detection; unset optional cues are left out."""
    a, g = col(analysis), col(gate)
    return F.to_json(F.struct(
        a["has_highlight"].alias("highlight"), a["has_shadow"].alias("shadow"),
        half_even(a["highlight_ratio"], 3).alias("highlight_ratio"),
        half_even(a["shadow_ratio"], 3).alias("shadow_ratio"),
        half_even(a["shadow_len_m"], 2).alias("shadow_len_m"),
        half_even(a["height_m"], 2).alias("height_m"),
        brain_letters(brain).alias("brains"),
        g["violation"].alias("physics_violation"), g["reason"].alias("violation_reason"),
        half_even(score, 3).alias("raw_score"), col(confidence).alias("confidence_pct"),
        half_even(verifier_p, 3).alias("verifier_p"), col(pings).cast("int").alias("persistence_pings")))
