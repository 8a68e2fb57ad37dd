"""Recency / frequency / monetary scoring and segment roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.functions import rfm_action, rfm_segment, rfm_sub_segment
from ledgerlens.operators.ranking import with_tiles


def rfm_base(txn: DataFrame, keys: Sequence[str] = ("cc_num",), as_of=None,
             legit=None, each=None) -> DataFrame:
    """Per-entity last date, recency in days, frequency and monetary (legit rows).

    Recency is measured from ``as_of`` or, by default, from the latest date of
    the whole table (fraud rows included): a one-row aggregate attached by a
    broadcast cross join (a single row, so the broadcast is bounded). ``each`` applies the aggregate to the
    rows of a table laid out by card (:meth:`ledgerlens.sources.bucketed.CardTable.each`); ``keys`` then include the card.
    """
    legit = legit if legit is not None else (F.col("is_fraud") == 0)

    def sums(rows: DataFrame) -> DataFrame:
        return (rows.where(legit)
                    .groupBy(*keys)
                    .agg(F.max("trans_date").alias("last_txn_date"),
                         F.count(F.lit(1)).alias("frequency"),
                         F.sum("amt").alias("monetary")))

    base = sums(txn) if each is None else each(sums)
    if as_of is None:
        latest = txn.agg(F.max("trans_date").alias("_as_of"))
    else:
        latest = txn.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("_as_of"))
    return (base.crossJoin(F.broadcast(latest))
                .withColumn("recency_days", F.datediff("_as_of", "last_txn_date"))
                .drop("_as_of"))


def rfm_score(base: DataFrame, tiles: int = 4, tie: Sequence[str] = ("cc_num",)) -> DataFrame:
    """Quartile scores: recency (most recent = highest), frequency and monetary (ascending).

    Each NTILE order ends in the ``tie`` columns so equal values split deterministically across tile
    edges. Building the result runs jobs: ``base`` is evaluated once and stored, and the cut rows of all
    three orders (``tiles - 1`` each) are found there in shared passes. The
    result itself is a projection of the stored base that compares each row with those literals.
    """
    orders = {name: [(value, descending), *[(c, False) for c in tie]]
              for name, value, descending in (("r_score", "recency_days", True), ("f_score", "frequency", False), ("m_score", "monetary", False))}
    return with_tiles(base, tiles, orders)


def with_segments(scored: DataFrame, sub_segments: bool = True) -> DataFrame:
    """Attach the segment (and the sub-segment and recommended action)."""
    out = scored.withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score")) \
                .withColumn("segment", rfm_segment("r_score", "f_score", "m_score"))
    if sub_segments:
        out = (out.withColumn("sub_segment", rfm_sub_segment("segment", "r_score", "f_score", "m_score"))
                  .withColumn("recommended_action", rfm_action("segment", "r_score", "f_score", "m_score")))
    return out


def segment_exposure(scored: DataFrame, txn: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Per segment: scored cards, cards with labelled (fraud) rows, their loss, and the
    segment's legit revenue, from a left join of per-card fraud totals (one row per
    card on both sides). Cards without fraud count with zero loss."""
    card_fraud = (txn.where(F.col(label) == 1)
                     .groupBy("cc_num")
                     .agg(F.count(F.lit(1)).alias("fraud_txns"), F.round(F.sum("amt"), 2).alias("fraud_loss"))
                     .withColumnRenamed("cc_num", "f_cc_num"))
    joined = scored.join(card_fraud, scored["cc_num"] == card_fraud["f_cc_num"], "left")
    loss = F.coalesce(F.col("fraud_loss"), F.lit(0))
    return (joined.groupBy("segment")
                  .agg(F.countDistinct("cc_num").alias("total_cards"),
                       F.countDistinct("f_cc_num").alias("cards_hit_by_fraud"),
                       F.sum(loss).alias("_loss"),
                       F.count(F.lit(1)).alias("_rows"),
                       F.sum("monetary").alias("_monetary"),
                       F.count("monetary").alias("_n_monetary")))


def share_of_total(grouped: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """Each group's share (percent) of the column total; ``grouped`` is already
    aggregated to a handful of rows, so the total is a window over those rows."""
    total = F.sum(value).over(Window.partitionBy())
    return grouped.withColumn(name, F.round(F.col(value) * F.lit(100) / F.nullif(total, F.lit(0)), digits)
                              .cast("double"))
