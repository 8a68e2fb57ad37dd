"""Per-entity period series: previous-period deltas, rolling means, cohorts, consistency.

All windows here are partitioned by an entity (card or category) over an
already aggregated entity x month table, so a window partition holds at most
one row per month of history, however hot the entity is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions import dec, month_start, months_between_starts, safe_div
from ledgerlens.functions.numeric import pct_exact

# ---------------------------------------------------------------------------
# Trend and consistency labels (original wording).
# ---------------------------------------------------------------------------
TREND_BUILDING = "Building history"
TREND_URGENT = "URGENT: >30% rolling decline"
TREND_WARNING = "WARNING: 10-30% rolling decline"
TREND_GROWING = "Growing"
TREND_STABLE = "Stable"
PATTERN_CONSISTENT = "Consistent"
PATTERN_VARIABLE = "Variable"
PATTERN_ERRATIC = "Erratic"
# ---------------------------------------------------------------------------


def previous_value(df: DataFrame, partition: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    """``LAG(value) OVER (PARTITION BY partition ORDER BY order)``: the previous existing
    row, not the previous calendar period (no gap filling)."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*partition).orderBy(*order)))


def period_delta(df: DataFrame, entity: Sequence[str], period: Sequence, value: str, prev: str, delta: str,
                 mode: str = "pct", digits: int = 1) -> DataFrame:
    """Previous period's value (previous existing row of the entity) and the change:
    ``mode="pct"`` -> ``ROUND((v - prev) * 100 / NULLIF(prev, 0), digits)``,
    ``mode="diff"`` -> ``ROUND(v - prev, digits)``. Decimal inputs stay exact."""
    out = previous_value(df, entity, period, value, prev)
    change = F.col(value) - F.col(prev)
    if mode == "pct":
        return out.withColumn(delta, pct_exact(change, prev, digits))
    if mode == "diff":
        return out.withColumn(delta, F.round(change, digits))
    raise ValueError("mode must be 'pct' or 'diff'")


def rolling_trend(df: DataFrame, entity: Sequence[str], order: Sequence, value: str, window: int = 3,
                  cuts=("0.70", "0.90", "1.10"), mean: str = "rolling_3m_avg", prev: str = "prev_rolling_avg",
                  change: str = "rolling_change", label: str = "trend_label", last_only: bool = False,
                  latest: DataFrame | None = None) -> DataFrame:
    """Rolling mean of the last ``window`` rows (2-digit rounded), its previous value,
    the change and the trend label (:func:`trend_label`).

    ``last_only`` keeps the rows of the latest period of all: ``order`` must then be one column, and
    ``latest`` may give that period as a one-row, one-column frame (default: the maximum over ``df``)."""
    rolled = rolling_mean(df, entity, order, value, window, mean)
    out = period_delta(rolled, entity, order, mean, prev, change, mode="diff", digits=2)
    out = out.withColumn(label, trend_label(mean, prev, cuts))
    if not last_only:
        return out
    (period,) = order
    latest = df.agg(F.max(period)) if latest is None else latest
    # one row: a bounded broadcast
    return out.crossJoin(F.broadcast(latest.toDF("_latest"))).where(F.col(period) == F.col("_latest")).drop("_latest")


def rolling_mean(df: DataFrame, partition: Sequence[str], order: Sequence, value: str, rows: int,
                 name: str, digits: int | None = 2) -> DataFrame:
    """Mean of the current and ``rows - 1`` preceding rows (shorter frames at the start)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    mean = F.avg(value).over(w)
    return df.withColumn(name, F.round(mean, digits) if digits is not None else mean)


def trend_label(current, previous, cuts=("0.70", "0.90", "1.10")) -> Column:
    """Rolling-trend label: no previous -> building history; <= 70% urgent; <= 90% warning;
    >= 110% growing; else stable."""
    cur = F.col(current) if isinstance(current, str) else current
    prev = F.col(previous) if isinstance(previous, str) else previous
    urgent, warning, growing = (dec(c) for c in cuts)
    return (F.when(prev.isNull(), TREND_BUILDING)
             .when(cur <= prev * urgent, TREND_URGENT)
             .when(cur <= prev * warning, TREND_WARNING)
             .when(cur >= prev * growing, TREND_GROWING)
             .otherwise(TREND_STABLE))


def entity_months(txn: DataFrame, entity: str, date: str, value: str, legit: Column) -> DataFrame:
    """Entity x month table with the legit value sum and legit row count (all rows kept,
    so an entity's first month counts fraud-only months too)."""
    return (txn.where(F.col(entity).isNotNull())
               .groupBy(entity, month_start(date).alias("txn_month"))
               .agg(F.sum(F.when(legit, F.col(value)).otherwise(0)).alias("spend"),
                    F.sum(F.when(legit, 1).otherwise(0)).alias("legit_rows")))


def cohort_matrix(txn: DataFrame, entity: str = "cc_num", date: str = "trans_date", value: str = "amt",
                  legit: Column | None = None, each=None) -> DataFrame:
    """First-seen cohort x month: active entities, legit spend, mean spend per entity.

    The cohort month comes from all rows; spend from legit rows only. The
    first-seen month is a window over the entity's month rows (<= one per month). ``each`` applies that
    per-entity part to a table laid out by entity.
    """
    legit = legit if legit is not None else (F.col("is_fraud") == 0)

    def with_cohort(rows: DataFrame) -> DataFrame:
        months = entity_months(rows, entity, date, value, legit)
        return months.withColumn("cohort_month", F.min("txn_month").over(Window.partitionBy(entity)))

    active = (with_cohort(txn) if each is None else each(with_cohort)).where(F.col("legit_rows") > 0)
    return (active.groupBy("cohort_month", "txn_month")
                  .agg(F.count(entity).alias("active_cards"),
                       F.sum("spend").alias("_spend"),
                       F.count("spend").alias("_n"))
                  .withColumn("month_number", months_between_starts("cohort_month", "txn_month")))


def consistency(monthly: DataFrame, keys: Sequence[str], value: str, min_periods: int = 3,
                cuts=("0.3", "0.7")) -> DataFrame:
    """Mean / sample stddev / min / max of an entity's period values, coefficient of
    variation (of the rounded stats) and its label; entities with >= min_periods.

    The deviation comes from exact decimal sums of x and x * x (values of 2 decimals), so no
    order of merging can change its digits."""
    x, n = F.col(value).cast("decimal(18,2)"), F.count(value).cast("decimal(9,0)")
    # n * sum(x^2) - sum(x)^2 in hundredths squared, exact
    cents = (x * 100).cast("decimal(18,0)")
    spread = n * F.sum((cents * cents).cast("decimal(28,0)")).cast("decimal(29,0)") - (F.sum(cents) * F.sum(cents)).cast("decimal(38,0)")
    stddev = F.when(F.count(value) > 1, F.sqrt(spread.cast("double") / (n * (n - 1)).cast("double")) / 100)
    stats = (monthly.groupBy(*keys)
                    .agg(F.count(F.lit(1)).alias("active_months"),
                         F.round(F.sum(value) / F.count(value), 2).alias("_mean"),
                         F.round(stddev, 2).alias("_sd"),
                         F.round(F.min(value), 2).alias("_min"),
                         F.round(F.max(value), 2).alias("_max"))
                    .where(F.col("active_months") >= min_periods))
    sd = F.col("_sd").cast("decimal(24,2)")
    cv = safe_div(sd, F.col("_mean"))
    return (stats.withColumn("_cv", cv)
                 .withColumn("spend_pattern",
                             F.when(F.col("_cv") < dec(cuts[0]), PATTERN_CONSISTENT)
                              .when(F.col("_cv") < dec(cuts[1]), PATTERN_VARIABLE)
                              .otherwise(PATTERN_ERRATIC)))
