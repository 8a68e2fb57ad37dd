"""Continuous percentiles per group from counts of values.

``PERCENTILE_CONT`` needs a group's values in order. Here the rows are first reduced to (group, value, count), which combines map-side and
shuffles by group and value, so a group with a third of all rows is spread over all tasks and no task holds its rows. The percentile is then found by
walking the counts: the running count says at which values the two neighbouring ranks lie. Only distinct values are ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F


def percentile_digits(q: float, value_digits: int = 2) -> int:
    """Decimals of an interpolated percentile of values with ``value_digits`` decimals: those and the decimals of ``q``."""
    return value_digits + max(0, -Decimal(str(q)).as_tuple().exponent)


def value_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str], value_digits: int = 2) -> DataFrame:
    """``keys``, ``_which`` (position in ``values``), ``_units`` (value in units of its last decimal, long) and ``_n``: how often each value occurs.

    NULL values are left out, rows with a NULL key are a group of their own. Values are exact numbers of at most ``value_digits`` decimals (further
    ones are rounded away) whose units fit a long.
    """
    unit = F.lit(10 ** value_digits)
    each = F.array(*[F.struct(F.lit(i).alias("_which"), F.round(F.col(v) * unit).cast("long").alias("_units")) for i, v in enumerate(values)])
    rows = df.select(*keys, F.explode(each).alias("_v")).select(*keys, "_v._which", "_v._units").where(F.col("_units").isNotNull())
    return rows.groupBy(*keys, "_which", "_units").agg(F.count(F.lit(1)).alias("_n"))


def percentile_by(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], q: float, value_digits: int = 2) -> DataFrame:
    """Per group the exact continuous ``q`` percentile of several columns: ``keys`` and a decimal column for each ``name: column`` in ``values``.

    A group whose values of a column are all NULL gets NULL there, one without any value in any column no row. No rows give no groups.
    ``value_digits`` and the decimals of ``q`` may come to 6 together, for which the decimal arithmetic below is exact.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    if percentile_digits(q, value_digits) > 6:
        raise ValueError("the decimals of q and of the values must not come to more than 6")
    share = Fraction(str(q))
    walk = Window.partitionBy(*keys, "_which").orderBy("_units")
    # rank positions from 0: the percentile lies between ranks ``low`` and ``low + 1``, ``part`` / denominator of the way
    placed = (value_counts(df, keys, list(values.values()), value_digits)
              .withColumns({"_to": F.sum("_n").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                            "_total": F.sum("_n").over(walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
              .withColumn("_scaled", (F.col("_total") - 1) * share.numerator)
              .withColumns({"_low": F.expr(f"_scaled div {share.denominator}"),
                            "_part": F.col("_scaled") % share.denominator}))

    def holds(rank: Column) -> Column:
        return (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n"))

    at_low, at_high = holds(F.col("_low")), holds(F.least(F.col("_low") + 1, F.col("_total") - 1))
    near = placed.where(at_low | at_high)            # one or two values per group and column
    digits = percentile_digits(q, value_digits)

    def level(i: int) -> Column:
        mine = F.col("_which") == i
        low = F.max(F.when(mine & at_low, F.col("_units"))).cast("decimal(19,0)")
        high = F.max(F.when(mine & at_high, F.col("_units"))).cast("decimal(19,0)")
        part = F.max(F.when(mine, F.col("_part"))).cast("decimal(9,0)")
        exact = (low + (high - low) * part / F.lit(Decimal(share.denominator))) / F.lit(Decimal(10 ** value_digits))
        return F.round(exact, digits).cast(f"decimal(24,{digits})")

    return near.groupBy(*keys).agg(*[level(i).alias(name) for i, name in enumerate(values)])

