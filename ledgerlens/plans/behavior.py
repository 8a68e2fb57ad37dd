"""Section 3: cohort spend matrix and spend consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import money, ratio
from ledgerlens.operators.rates import top_k
from ledgerlens.operators.series import cohort_matrix, consistency


def cohort_spend_matrix(txn: DataFrame, each=None) -> DataFrame:
    """3a: first-seen month cohort x month: active cards, legit spend, mean per card."""
    m = cohort_matrix(txn, each=each)
    return m.select(
        "cohort_month", "txn_month", "month_number", "active_cards",
        money("_spend").alias("cohort_spend"),
        ratio("_spend", "_n", 2).alias("avg_spend_per_card"),
    ).orderBy("cohort_month", "month_number")


def spend_consistency(txn: DataFrame, k: int = 50, min_periods: int = 3, offset: int = 0) -> DataFrame:
    """3b: monthly legit spend stats per card, coefficient of variation and label; top k by mean."""
    monthly = (txn.where(F.col("is_fraud") == 0)
                  .groupBy("cc_num", "customer_name", "trans_year", "trans_month")
                  .agg(F.sum("amt").alias("monthly_spend")))
    stats = consistency(monthly, ["cc_num", "customer_name"], "monthly_spend", min_periods)
    out = stats.select(
        "cc_num", "customer_name", "active_months",
        F.col("_mean").alias("_mean_exact"),
        F.col("_mean").cast("double").alias("avg_monthly_spend"),
        F.col("_sd").alias("stddev_spend"),
        F.col("_min").cast("double").alias("min_monthly_spend"),
        F.col("_max").cast("double").alias("max_monthly_spend"),
        F.round("_cv", 3).cast("double").alias("spend_cv"),
        "spend_pattern",
    )
    return top_k(out, k, [F.col("_mean_exact").desc(), F.col("cc_num"), F.col("customer_name")],
                 offset).drop("_mean_exact")
