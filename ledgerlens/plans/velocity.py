"""Section 4: distance bands, layered alerts, amount bands, RFM segment x fraud."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import amount_band, distance_band, money, pct, ratio
from ledgerlens.operators.alerts import layered_alerts
from ledgerlens.operators.rates import expected_vs_actual, label_rate
from ledgerlens.operators.rfm import rfm_base, rfm_score, segment_exposure, with_segments


def distance_band_rate(txn: DataFrame, rate=label_rate) -> DataFrame:
    """4a: fraud rate per home-to-merchant distance band, ordered by the band's nearest row."""
    g = rate(txn.withColumn("distance_band", distance_band("dist_km")), ["distance_band"],
             extra=[F.min("dist_km").alias("_min_dist")])
    return g.orderBy(F.col("_min_dist").asc_nulls_last()).select(
        "distance_band",
        F.col("n").alias("txn_count"),
        ratio("volume", "n", 2).alias("avg_amt"),
        F.col("label_n").alias("fraud_count"),
        pct("label_n", "n", 3).alias("fraud_rate_pct"),
    )


def layered_alerts_report(txn: DataFrame, **params) -> DataFrame:
    """4b: card-category-hours that pass the absolute rules, exceed the card's own
    recent p90, and fall in a risky population context; highest rule count first.

    Note: the context rates and the status come from the same fraud label the
    alerts are judged by, so the share of confirmed alerts is in-sample, not a
    measure of predictive power.
    """
    a = layered_alerts(txn, **params)
    return a.select(
        "cc_num", "trans_date", "txn_hour", "category", "txns_in_hour",
        F.col("spend_in_hour").cast("double").alias("spend_in_hour"),
        "fraud_in_hour",
        "flag_extreme_velocity", "flag_extreme_spend", "flag_merchant_scatter", "flag_night_burst",
        "rules_triggered",
        F.col("p90_txns").cast("double").alias("card_p90_txns"),
        F.col("p90_spend").cast("double").alias("card_p90_spend"),
        F.col("population_fraud_rate").cast("double").alias("context_fraud_rate_pct"),
        "context_label", "status",
    ).orderBy(F.col("rules_triggered").desc(), F.col("spend_in_hour").desc(), "cc_num", "trans_date", "txn_hour",
              "category")


def amount_band_rate(txn: DataFrame, rate=label_rate) -> DataFrame:
    """4c: fraud count per amount band against the count the portfolio rate predicts."""
    counts = (rate(txn.withColumn("band", amount_band("amt")), ["band"])
              .select("band", F.col("n").alias("txn_count"), F.col("label_n").alias("actual_fraud")))
    return (expected_vs_actual(counts)
            .withColumn("actual_fraud_rate_pct", pct("actual_fraud", "txn_count", 3))
            .select("band", "txn_count", "actual_fraud", "actual_fraud_rate_pct", "expected_if_random",
                    "fraud_deficit", "pct_below_expected")
            .orderBy("band"))


def segment_fraud_exposure(txn: DataFrame) -> DataFrame:
    """4d: per RFM segment (card-level scoring), cards hit by fraud and fraud loss."""
    scored = with_segments(rfm_score(rfm_base(txn, ["cc_num"])), sub_segments=False)
    g = segment_exposure(scored, txn)
    return g.select(
        "segment", "total_cards", "cards_hit_by_fraud",
        pct("cards_hit_by_fraud", "total_cards", 1).alias("pct_cards_hit"),
        money("_loss").alias("total_fraud_loss"),
        ratio("_loss", "_rows", 2).alias("avg_fraud_loss_per_card"),
        ratio("_monetary", "_n_monetary", 2).alias("avg_legit_spend_per_card"),
        pct("_loss", "_monetary", 2).alias("fraud_as_pct_of_segment_revenue"),
    ).orderBy(F.col("total_fraud_loss").desc(), "segment")
