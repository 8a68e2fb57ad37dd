"""Exact numeric helpers.

The reports compute ratios such as ``SUM(flag) * 100.0 / COUNT(*)`` and money
means in decimal arithmetic and round half away from zero. Spark decimal
arithmetic does the same: the quotient keeps 11-18 fractional digits before
``round``, so the half-up rounding is applied to the exact value. Results are
cast to DOUBLE only in the final projection.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dec(v) -> Column:
    """A decimal literal with the written scale (``dec('100.0')`` is DECIMAL(4,1))."""
    return F.lit(Decimal(str(v)))


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of a division error (ANSI mode raises)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def pct_exact(num, den, digits: int) -> Column:
    """``ROUND(num * 100.0 / NULLIF(den, 0), digits)`` kept as DECIMAL (feeds later arithmetic)."""
    return F.round(safe_div(_c(num) * dec("100"), den), digits)


def pct(num, den, digits: int) -> Column:
    """``ROUND(num * 100.0 / NULLIF(den, 0), digits)`` in decimal arithmetic, as DOUBLE."""
    return pct_exact(num, den, digits).cast("double")


def ratio(num, den, digits: int) -> Column:
    """``ROUND(num / NULLIF(den, 0), digits)`` in decimal arithmetic, as DOUBLE."""
    return F.round(safe_div(num, den), digits).cast("double")


def money(col, digits: int = 2) -> Column:
    """``ROUND(x, 2)`` of an exact decimal, as DOUBLE for the result set."""
    return F.round(_c(col), digits).cast("double")


def flag_sum(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def cond_sum(cond: Column, value) -> Column:
    """``SUM(CASE WHEN cond THEN value ELSE 0 END)``."""
    return F.sum(F.when(cond, _c(value)).otherwise(0))
