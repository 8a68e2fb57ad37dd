"""Section 1: RFM segments, age bands, month-over-month growth, rolling decline.

``each`` applies per-card work to a table laid out by card (:meth:`ledgerlens.sources.bucketed.CardTable.each`); default: to ``txn``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import age_band, money, month_index, ratio
from ledgerlens.operators.ranking import global_rank
from ledgerlens.operators.rfm import rfm_base, rfm_score, share_of_total, with_segments
from ledgerlens.operators.series import TREND_URGENT, TREND_WARNING, period_delta, rolling_trend

RFM_KEYS = ("cc_num", "customer_name", "gender", "age", "job")


def rfm_segments(txn: DataFrame, each=None) -> DataFrame:
    """1a: cardholders, mean spend, recency, frequency and revenue share per sub-segment."""
    scored = with_segments(rfm_score(rfm_base(txn, RFM_KEYS, each=each), tie=RFM_KEYS))
    grouped = (scored.groupBy("sub_segment", "recommended_action")
                     .agg(F.count(F.lit(1)).alias("cardholders"),
                          ratio(F.sum("monetary"), F.count("monetary"), 2).alias("avg_2yr_spend"),
                          ratio(F.sum("recency_days"), F.count("recency_days"), 0).alias("avg_recency_days"),
                          ratio(F.sum("frequency"), F.count("frequency"), 0).alias("avg_txn_count"),
                          F.sum("monetary").alias("_revenue")))
    return (share_of_total(grouped, "_revenue", "pct_of_total_revenue", 1)
            .withColumn("total_revenue", money("_revenue"))
            .orderBy(F.col("_revenue").desc(), "sub_segment", "recommended_action")
            .select("sub_segment", "recommended_action", "cardholders", "avg_2yr_spend",
                    "avg_recency_days", "avg_txn_count", "total_revenue", "pct_of_total_revenue"))


def age_band_spend(txn: DataFrame) -> DataFrame:
    """1b: legit spend by age band x gender, with spend per distinct cardholder."""
    legit = txn.where(F.col("is_fraud") == 0)
    g = (legit.groupBy(age_band("age").alias("age_band"), "gender")
              .agg(F.countDistinct("cc_num").alias("cardholders"),
                   F.count(F.lit(1)).alias("total_txns"),
                   F.sum("amt").alias("_spend")))
    return g.select(
        "age_band", "gender", "cardholders", "total_txns",
        money("_spend").alias("total_spend"),
        ratio("_spend", "total_txns", 2).alias("avg_txn_amt"),
        ratio("_spend", "cardholders", 2).alias("spend_per_cardholder"),
    ).orderBy(F.col("spend_per_cardholder").desc(), "age_band", "gender")


def category_mom_growth(txn: DataFrame) -> DataFrame:
    """1c: monthly legit spend per category, previous month's spend and growth %."""
    monthly = (txn.where(F.col("is_fraud") == 0)
                  .groupBy("trans_year", "trans_month", "category")
                  .agg(F.sum("amt").alias("_spend")))
    growth = period_delta(monthly, ["category"], ["trans_year", "trans_month"], "_spend", "_prev", "_growth",
                          mode="pct", digits=1)
    return growth.select(
        "trans_year", "trans_month", "category",
        money("_spend").alias("monthly_spend"),
        money("_prev").alias("prev_month_spend"),
        F.col("_growth").cast("double").alias("mom_growth_pct"),
    ).orderBy("trans_year", "trans_month", "category")


def card_month_trend(txn: DataFrame, window: int = 3, base_year: int = 2019, last_only: bool = False, each=None) -> DataFrame:
    """Per card and month: legit spend, rolling mean over the last ``window`` active
    months, its previous value, change and trend label; ``last_only``: rows of the table's latest month only."""
    # latest month of the whole table: a two-column scan, not a second pass over the trend windows
    latest = txn.agg(F.max(month_index("trans_year", "trans_month", base_year))) if last_only else None

    def trend(rows: DataFrame) -> DataFrame:
        monthly = (rows.groupBy("cc_num", "customer_name", "trans_year", "trans_month")
                       .agg(F.round(F.sum(F.when(F.col("is_fraud") == 0, F.col("amt")).otherwise(0)), 2)
                            .alias("legit_spend"))
                       .withColumn("month_seq", month_index("trans_year", "trans_month", base_year)))
        return rolling_trend(monthly, ["cc_num"], ["month_seq"], "legit_spend", window, last_only=last_only, latest=latest)

    return trend(txn) if each is None else each(trend)


def rolling_spend_decline(txn: DataFrame, each=None) -> DataFrame:
    """1d: cards declining in the latest month, ranked (urgent first, then larger rolling mean)."""
    flagged = (card_month_trend(txn, last_only=True, each=each)
               .where(F.col("trend_label").isin(TREND_URGENT, TREND_WARNING))
               .withColumn("_priority", F.when(F.col("trend_label") == TREND_URGENT, 1)
                           .when(F.col("trend_label") == TREND_WARNING, 2).otherwise(3)))
    ranked = global_rank(flagged, [("_priority", False), ("rolling_3m_avg", True)], "retention_priority_rank")
    return ranked.select(
        "cc_num", "customer_name", "trans_year", "trans_month",
        F.col("legit_spend").cast("double").alias("current_month_spend"),
        F.col("rolling_3m_avg").cast("double").alias("rolling_3m_avg"),
        F.col("prev_rolling_avg").cast("double").alias("prev_rolling_avg"),
        F.col("rolling_change").cast("double").alias("rolling_change"),
        "trend_label", "retention_priority_rank",
    ).orderBy("retention_priority_rank", "cc_num")
