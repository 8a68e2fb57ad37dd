"""RFM segment rules: pure functions of the three quartile scores (1..4)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Segment, sub-segment and action labels (original wording).
# ---------------------------------------------------------------------------
CHAMPIONS = "Champions"
LOYAL = "Loyal"
PROMISING = "Promising"
AT_RISK = "At Risk"
LOST = "Lost"
NEEDS_ATTENTION = "Needs Attention"

ACTIVE_LOW_SPENDER = "Active low-spender"
HIGH_VALUE_GONE_QUIET = "High-value; gone quiet"
PLATEAU = "Plateau"
FREQUENT_SMALL_TICKET = "Frequent small-ticket"
MIXED_SIGNALS = "Needs Attention: Mixed signals"

ACTION_STANDARD = "Standard segment playbook"
ACTION_WIN_BACK = "PRIORITY WIN-BACK — high revenue at risk"
ACTION_SPEND_MORE = "Spend-more offer — already engaged"
ACTION_MONITOR = "Monitor - no urgency"
ACTION_UPGRADE = "Category upgrade offer"
ACTION_REVIEW = "Queue for manual review"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rfm_segment(r, f, m) -> Column:
    """Main segment; the first matching rule wins."""
    r, f, m = _c(r), _c(f), _c(m)
    return (F.when((r >= 3) & (f >= 3) & (m >= 3), CHAMPIONS)
             .when((r >= 3) & (f >= 2), LOYAL)
             .when((r >= 3) & (f < 2), PROMISING)
             .when((r < 2) & (f >= 3), AT_RISK)
             .when((r < 2) & (f < 2), LOST)
             .otherwise(NEEDS_ATTENTION))


def rfm_sub_segment(segment, r, f, m) -> Column:
    """Split 'Needs Attention' into finer groups; other segments keep their name."""
    segment, r, f, m = _c(segment), _c(r), _c(f), _c(m)
    return (F.when(segment != NEEDS_ATTENTION, segment)
             .when((r >= 3) & (m <= 2), ACTIVE_LOW_SPENDER)
             .when((m >= 3) & (r <= 2), HIGH_VALUE_GONE_QUIET)
             .when((f == 2) & (m == 2), PLATEAU)
             .when((r == 2) & (f >= 2) & (m <= 2), FREQUENT_SMALL_TICKET)
             .otherwise(MIXED_SIGNALS))


def rfm_action(segment, r, f, m) -> Column:
    """Recommended action; note the rule order differs from the sub-segment rules."""
    segment, r, f, m = _c(segment), _c(r), _c(f), _c(m)
    return (F.when(segment != NEEDS_ATTENTION, ACTION_STANDARD)
             .when((m >= 3) & (r <= 2), ACTION_WIN_BACK)
             .when((r >= 3) & (m <= 2), ACTION_SPEND_MORE)
             .when((f == 2) & (m == 2), ACTION_MONITOR)
             .when((r == 2) & (f >= 2) & (m <= 2), ACTION_UPGRADE)
             .otherwise(ACTION_REVIEW))
