"""Calendar column expressions with the boundary-counting semantics of the reports."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def age_at(dob, as_of="2020-12-31") -> Column:
    """Whole years between ``dob`` and ``as_of``.

    Year difference minus one when the birthday (month*100 + day) falls after
    the as-of day in the as-of year.
    """
    dob = _c(dob)
    as_of = _date_lit(as_of)
    later_birthday = (F.month(dob) * 100 + F.dayofmonth(dob)) > (F.month(as_of) * 100 + F.dayofmonth(as_of))
    return (F.year(as_of) - F.year(dob) - F.when(later_birthday, 1).otherwise(0)).cast("int")


def month_index(year, month, base_year: int = 2019) -> Column:
    """Consecutive month number: ``(year - base_year) * 12 + month``."""
    return ((_c(year) - F.lit(base_year)) * 12 + _c(month)).cast("int")


def month_start(d) -> Column:
    """First day of the month of a date/timestamp (as a DATE)."""
    return F.trunc(_c(d).cast("date"), "month")


def months_between_starts(a, b) -> Column:
    """Month boundaries crossed from ``a`` to ``b`` (calendar arithmetic, not elapsed time)."""
    a, b = _c(a), _c(b)
    return ((F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))).cast("int")


def epoch_second(ts) -> Column:
    """Whole-second count of a TIMESTAMP_NTZ wall-clock value since 1970-01-01 00:00:00.

    Built from the wall-clock fields (day number, hour, minute, second), so it
    never passes through a session-time-zone conversion: a daylight-saving
    change in the session zone cannot shift it. Fractional seconds are dropped
    (floor), which makes differences count second boundaries.
    """
    ts = _c(ts)
    days = F.datediff(ts.cast("date"), F.lit(_dt.date(1970, 1, 1))).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(a, b) -> Column:
    """Second boundaries crossed from ``a`` to ``b``.

    Difference of whole-second epochs, so 00:00:00.9 -> 00:00:01.1 counts 1
    (boundary counting), unlike an elapsed-time difference.
    """
    return epoch_second(b) - epoch_second(a)
