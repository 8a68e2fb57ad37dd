"""Registry of the data products and loaders for the prepared table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.plans import adhoc, behavior, by_card, category, from_states, geography, operations, preparation, segmentation, velocity
from ledgerlens.session import scratch_path
from ledgerlens.sources.fixtures import raw_exports, raw_from_driver_tables
from ledgerlens.sources.sinks import read_transactions, write_transactions

# name -> report(transactions) -> DataFrame, in the order of the original scripts.
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sanity_profile": preparation.sanity_profile,
    "rfm_segments": segmentation.rfm_segments,
    "age_band_spend": segmentation.age_band_spend,
    "category_mom_growth": segmentation.category_mom_growth,
    "rolling_spend_decline": segmentation.rolling_spend_decline,
    "category_scorecard": category.category_scorecard,
    "category_loss_priority": category.category_loss_priority,
    "top_merchants": category.top_merchants,
    "hour_category_pattern": category.hour_category_pattern,
    "cohort_spend_matrix": behavior.cohort_spend_matrix,
    "spend_consistency": behavior.spend_consistency,
    "distance_band_rate": velocity.distance_band_rate,
    "layered_alerts": velocity.layered_alerts_report,
    "amount_band_rate": velocity.amount_band_rate,
    "segment_fraud_exposure": velocity.segment_fraud_exposure,
    "state_risk": geography.state_risk,
    "city_size_rate": geography.city_size_rate,
    "fraud_after_large": adhoc.fraud_after_large,
    "fraud_rate_jumps": adhoc.fraud_rate_jumps,
    "elevated_states": adhoc.elevated_states,
}


def _from_states(report: Callable[[DataFrame], DataFrame], txn: DataFrame) -> DataFrame:
    return report(from_states.stored_states(txn))


# further queries over the prepared table, and over the tables of a folder
EXTRAS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "card_baselines": operations.card_baselines,
    "large_fraud_pairs": operations.large_fraud_pairs,
    "merchant_lookup": operations.merchant_lookup,
    "layered_alerts_by_counts": partial(velocity.layered_alerts_report, history="counts"),
    "sketched_cards": from_states.sketched_cards,
    **{f"{name}_from_states": partial(_from_states, report) for name, report in from_states.STATE_REPORTS.items()},
    **{f"{name}_by_card": partial(by_card.by_card, name) for name in by_card.CARD_REPORTS},
}


def transactions_from_driver_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared table computed (lazily) from the driver tables at ``sf_dir``, in one pass over them."""
    return preparation.prepare_transactions(raw_from_driver_tables(spark, sf_dir))


def prepared_from_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared table from the two raw exports, combined by column name."""
    return preparation.prepare_transactions(*raw_exports(spark, sf_dir))


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table written to the shared folder and read back."""
    path = scratch_path(spark, "transactions")
    write_transactions(prepared_from_exports(spark, sf_dir), path)
    return read_transactions(spark, path)


def prepared_for_comparison(txn: DataFrame) -> DataFrame:
    """The prepared table as a result set: money as DOUBLE and the trig distance
    rounded to 4 digits (0.1 m). JVM and C math libraries differ in the last
    bits of cos/acos, and acos near 1 amplifies that ~100x, so a 6-digit
    rounding still flips on rows that sit on a rounding boundary."""
    return (txn.withColumn("amt", F.col("amt").cast("double"))
               .withColumn("dist_km", F.round("dist_km", 4)))


def register_transactions_view(txn: DataFrame, name: str = "transactions") -> DataFrame:
    """Expose the prepared table to ``spark.sql`` under ``name`` (a temp view; no copy)."""
    txn.createOrReplaceTempView(name)
    return txn


def run_report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "prepare_transactions":
        return prepared_for_comparison(prepared_from_exports(spark, sf_dir))
    if name == "stored_transactions":
        return prepared_for_comparison(stored_transactions(spark, sf_dir))
    if name == "replaced_transactions":
        return prepared_for_comparison(operations.replaced_transactions(spark, sf_dir))
    if name == "csv_load":
        return operations.csv_load(spark, sf_dir)
    return (REPORTS | EXTRAS)[name](transactions_from_driver_tables(spark, sf_dir))
