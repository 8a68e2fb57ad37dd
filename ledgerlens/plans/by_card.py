"""The per-card reports over a table laid out by card."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import behavior, segmentation, velocity
from ledgerlens.session import scratch_path
from ledgerlens.sources.bucketed import CardTable, save_by_card
from ledgerlens.sources.sinks import read_transactions, write_transactions

# report name -> report(transactions, each=...) -> DataFrame
CARD_REPORTS: dict[str, Callable[..., DataFrame]] = {
    "rfm_segments": segmentation.rfm_segments,
    "rolling_spend_decline": segmentation.rolling_spend_decline,
    "cohort_spend_matrix": behavior.cohort_spend_matrix,
    "layered_alerts": velocity.layered_alerts_report,
}


def card_table(txn: DataFrame, buckets: int | None = None) -> CardTable:
    """``txn`` stored once, then laid out by card in the shared folder (default: as many buckets as shuffle partitions)."""
    spark: SparkSession = txn.sparkSession
    base = scratch_path(spark, "cards")
    facts = read_transactions(spark, write_transactions(txn, f"{base}/facts"))
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return save_by_card(facts, f"cards_{uuid.uuid4().hex[:12]}", count, base)


def by_card(name: str, txn: DataFrame) -> DataFrame:
    """The report ``name`` from a table of ``txn`` laid out by card."""
    cards = card_table(txn)
    return CARD_REPORTS[name](cards.rows, each=cards.each)
