"""Section 2: category, merchant and hour risk.

``rate`` is :func:`label_rate` over transactions or :func:`ledgerlens.operators.rollup.merged_rate` over stored states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import money, pct, ratio
from ledgerlens.operators.rates import label_rate, rank_by, top_k


def category_scorecard(txn: DataFrame, rate=label_rate) -> DataFrame:
    """2a: volume, cards, size, fraud count, rate and loss per category."""
    g = rate(txn, ["category"], entity="cc_num")
    return g.select(
        "category",
        F.col("n").alias("total_txns"),
        F.col("entities").alias("unique_cards"),
        money("volume").alias("gross_volume"),
        ratio("volume", "n", 2).alias("avg_txn_size"),
        F.col("label_n").alias("fraud_txns"),
        pct("label_n", "n", 3).alias("fraud_rate_pct"),
        money("loss").alias("fraud_dollar_loss"),
    ).orderBy(F.col("gross_volume").desc(), "category")


def category_loss_priority(txn: DataFrame, rate=label_rate) -> DataFrame:
    """2b: fraud loss as % of volume; ranked on the unrounded ratio, sorted on the rounded one."""
    g = rate(txn, ["category"])
    loss_ratio = F.col("loss") * F.lit(100) / F.nullif(F.col("volume"), F.lit(0))
    ranked = rank_by(g, loss_ratio, "intervention_priority")
    return ranked.select(
        "category",
        money("volume").alias("total_volume"),
        money("loss").alias("fraud_loss"),
        pct("loss", "volume", 2).alias("loss_rate_pct"),
        F.col("intervention_priority"),
    ).orderBy(F.col("loss_rate_pct").desc(), "category")


def top_merchants(txn: DataFrame, k: int = 20) -> DataFrame:
    """2c: top-k (merchant, category) pairs by volume (ties broken by the pair)."""
    g = label_rate(txn, ["merchant", "category"])
    out = g.select(
        "merchant", "category",
        F.col("n").alias("total_txns"),
        F.col("volume").alias("_volume"),
        money("volume").alias("gross_volume"),
        ratio("volume", "n", 2).alias("avg_txn_size"),
        pct("label_n", "n", 2).alias("fraud_rate_pct"),
    )
    return top_k(out, k, [F.col("_volume").desc(), F.col("merchant"), F.col("category")]).drop("_volume")


def hour_category_pattern(txn: DataFrame, rate=label_rate) -> DataFrame:
    """2d: transactions, mean amount, fraud count and rate per hour x category."""
    g = rate(txn, ["trans_hour", "category"])
    return g.select(
        "trans_hour", "category",
        F.col("n").alias("txn_count"),
        ratio("volume", "n", 2).alias("avg_amt"),
        F.col("label_n").alias("fraud_count"),
        pct("label_n", "n", 2).alias("fraud_rate_pct"),
    ).orderBy("trans_hour", "category")
