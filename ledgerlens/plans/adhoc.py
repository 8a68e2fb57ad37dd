"""Ad hoc questions: fraud after large purchases, fraud-rate jumps, elevated states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import dec, money, pct, pct_exact, risk_condition, seconds_between
from ledgerlens.operators.joins import interval_join, nearest_preceding_pairs
from ledgerlens.operators.rates import label_rate, top_k
from ledgerlens.operators.series import period_delta


def fraud_after_large(txn: DataFrame, min_amount: int = 500, horizon_hours: int = 24, k: int = 50,
                      method: str = "nearest") -> DataFrame:
    """A1: legit purchases over ``min_amount`` followed on the same card by a fraud
    within ``horizon_hours`` (both ends inclusive); the k closest pairs.

    Order: gap in hours rounded to 2 digits, exact seconds, card, fraud time, then the latest purchase
    first and the smaller amount. Among the pairs of one fraud row that is the order in which
    ``method="nearest"`` (default) keeps each fraud row's k most recent qualifying purchases
    (:func:`nearest_preceding_pairs`), so the cut loses nothing and no card's pairs are all formed.
    ``"all_pairs"`` forms every pair with the time-bucketed interval join; it is the
    brute-force reference for tests.
    """
    large = (txn.where((F.col("is_fraud") == 0) & (F.col("amt") > min_amount))
                .select("cc_num", F.col("trans_ts").alias("legit_txn_time"), F.col("amt").alias("legit_amt")))
    fraud = txn.where(F.col("is_fraud") == 1).select("cc_num", F.col("trans_ts").alias("fraud_txn_time"))
    if method == "all_pairs":
        pairs = interval_join(large, fraud, "cc_num", "legit_txn_time", "fraud_txn_time", horizon_hours * 3600)
    elif method == "nearest":
        pairs = nearest_preceding_pairs(large, fraud, "cc_num", "legit_txn_time", "fraud_txn_time", k,
                                        horizon_hours * 3600, left_tie="legit_amt")
    else:
        raise ValueError("method must be 'nearest' or 'all_pairs'")
    seconds = seconds_between("legit_txn_time", "fraud_txn_time")
    out = pairs.select(
        "cc_num", "legit_txn_time", "legit_amt", "fraud_txn_time",
        F.round(seconds.cast("decimal(20,0)") / dec("3600.0"), 2).alias("_hours"), seconds.alias("_seconds"),
    )
    ranked = top_k(out, k, [F.col("_hours").asc(), F.col("_seconds").asc(), F.col("cc_num"), F.col("fraud_txn_time"),
                            F.col("legit_txn_time").desc(), F.col("legit_amt")])
    return ranked.select("cc_num", "legit_txn_time", F.col("legit_amt").cast("double").alias("legit_amt"), "fraud_txn_time",
                         F.col("_hours").cast("double").alias("hours_between"))


def fraud_rate_jumps(txn: DataFrame, k: int = 10, rate=label_rate) -> DataFrame:
    """A2: the k largest month-over-month rises of a category's fraud rate."""
    monthly = (rate(txn, ["category", "trans_year", "trans_month"])
               .select("category", "trans_year", "trans_month", pct_exact("label_n", "n", 3).alias("_rate")))
    jumps = period_delta(monthly, ["category"], ["trans_year", "trans_month"], "_rate", "_prev", "_change",
                         mode="diff", digits=3)
    out = (jumps.where(F.col("_prev").isNotNull())
                .select("category", "trans_year", "trans_month",
                        F.col("_rate").cast("double").alias("fraud_rate"), "_change"))
    ranked = top_k(out, k, [F.col("_change").desc(), F.col("category"), F.col("trans_year"), F.col("trans_month")])
    return ranked.withColumn("fraud_rate_change", F.col("_change").cast("double")).drop("_change")


def elevated_states(txn: DataFrame, k: int = 5, min_rate_pct: int = 1, min_loss: int = 10000, rate=label_rate) -> DataFrame:
    """A3: top-k states by fraud loss with rate above ``min_rate_pct``% and loss above ``min_loss``."""
    g = rate(txn, ["state"]).where(risk_condition("label_n", "n", "loss", min_rate_pct, min_loss))
    out = g.select("state", F.col("label_n").alias("fraud_txns"),
                   pct("label_n", "n", 3).alias("fraud_rate_pct"),
                   money("loss").alias("fraud_loss"), F.col("loss").alias("_loss"))
    return top_k(out, k, [F.col("_loss").desc(), F.col("state")]).drop("_loss")
