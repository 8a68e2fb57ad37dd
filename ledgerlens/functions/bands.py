"""Banding and labelling rules as Column expressions.

``band`` evaluates a searched CASE: the first edge the value is below wins,
anything else (including NULL, because a NULL comparison is not true) gets the
last label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(col, edges: Sequence, labels: Sequence[str]) -> Column:
    """Half-open bands ``[-inf, e0), [e0, e1), ..., [e_last, inf)``; NULL -> last label."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    col = _c(col)
    expr = None
    for edge, label in zip(edges, labels):
        expr = F.when(col < edge, label) if expr is None else expr.when(col < edge, label)
    return expr.otherwise(labels[-1])


# ---------------------------------------------------------------------------
# Band edges and labels of the reports (must equal the original
# wording; listed in their natural order).
# ---------------------------------------------------------------------------
AGE_EDGES = (25, 40, 55, 70)
AGE_LABELS = ("Gen Z (< 25)", "Millennial (25-39)", "Gen X (40-54)", "Boomer (55-69)", "Silent (70+)")

DISTANCE_EDGES = (30, 60, 100)
DISTANCE_LABELS = ("< 30 km (local)", "30-60 km", "60-100 km", "> 100 km (remote)")

AMOUNT_EDGES = (10, 50, 200, 500, 1000)
AMOUNT_LABELS = ("1: < $10", "2: $10-50", "3: $50-200 (safe zone)", "4: $200-500", "5: $500-1000", "6: > $1000")

CITY_SIZE_EDGES = (5000, 25000, 100000, 500000)
CITY_SIZE_LABELS = ("Rural (< 5K)", "Small town (5K-25K)", "Mid-size (25K-100K)",
                    "Large city (100K-500K)", "Metro (500K+)")

CONFIDENCE_CUTS = (10000, 2000, 500)
CONFIDENCE_LABELS = ("High confidence", "Medium confidence", "Low confidence", "Indicative only")

RISK_FLAG_LABEL = "ELEVATED RISK: rate > 1% AND loss > $10K"
# ---------------------------------------------------------------------------


def age_band(age) -> Column:
    """Integer age bands with inclusive ranges (< 25, 25-39, 40-54, 55-69, else)."""
    return band(age, AGE_EDGES, AGE_LABELS)


def distance_band(dist_km) -> Column:
    return band(dist_km, DISTANCE_EDGES, DISTANCE_LABELS)


def amount_band(amt) -> Column:
    return band(amt, AMOUNT_EDGES, AMOUNT_LABELS)


def city_size_band(city_pop) -> Column:
    return band(city_pop, CITY_SIZE_EDGES, CITY_SIZE_LABELS)


def confidence_label(n, cuts=CONFIDENCE_CUTS, labels=CONFIDENCE_LABELS) -> Column:
    """Sample-size confidence: ``n >= cuts[0]`` -> labels[0], ..., else the last label."""
    n = _c(n)
    expr = None
    for cut, label in zip(cuts, labels):
        expr = F.when(n >= cut, label) if expr is None else expr.when(n >= cut, label)
    return expr.otherwise(labels[-1])


def risk_condition(fraud_count, total_count, loss, min_rate_pct=1, min_loss=10000) -> Column:
    """Exact test ``fraud * 100 / total > min_rate_pct AND loss > min_loss``.

    The rate comparison is done by cross-multiplication, so it is exact.
    """
    return ((_c(fraud_count) * 100 > _c(total_count) * min_rate_pct)
            & (_c(loss) > min_loss))


def risk_flag(fraud_count, total_count, loss, min_rate_pct=1, min_loss=10000,
              label: str = RISK_FLAG_LABEL) -> Column:
    """Label when the state is elevated, else the empty string (not NULL)."""
    return F.when(risk_condition(fraud_count, total_count, loss, min_rate_pct, min_loss), label).otherwise("")
