"""Section 5: state-level risk and city size (``rate`` as in :mod:`ledgerlens.plans.category`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import city_size_band, confidence_label, money, pct, ratio, risk_flag
from ledgerlens.operators.rates import label_rate


def state_risk(txn: DataFrame, min_rows: int = 200, rate=label_rate) -> DataFrame:
    """5a: per state rate, loss, sample-size confidence and elevated-risk flag (>= min_rows rows)."""
    g = rate(txn, ["state"], entity="cc_num").where(F.col("n") >= min_rows)
    return g.select(
        "state",
        F.col("n").alias("total_txns"),
        F.col("entities").alias("unique_cards"),
        money("volume").alias("total_volume"),
        F.col("label_n").alias("fraud_txns"),
        pct("label_n", "n", 3).alias("fraud_rate_pct"),
        money("loss").alias("fraud_loss"),
        confidence_label("n").alias("rate_confidence"),
        risk_flag("label_n", "n", "loss").alias("high_risk_flag"),
    ).orderBy(F.col("fraud_rate_pct").desc(), "state")


def city_size_rate(txn: DataFrame, rate=label_rate) -> DataFrame:
    """5b: fraud rate by city population band, bands ordered by their smallest population."""
    g = rate(txn.withColumn("city_size", city_size_band("city_pop")), ["city_size"],
             entity="cc_num", extra=[F.min("city_pop").alias("_min_pop")])
    return g.orderBy(F.col("_min_pop").asc_nulls_last()).select(
        "city_size",
        F.col("n").alias("txn_count"),
        F.col("entities").alias("unique_cards"),
        money("volume").alias("total_volume"),
        ratio("volume", "n", 2).alias("avg_txn_amt"),
        F.col("label_n").alias("fraud_txns"),
        pct("label_n", "n", 3).alias("fraud_rate_pct"),
    )
