"""The prepared table laid out by card: a bucketed table, and beside it the cards that are too large for a bucket.

A scan of a bucketed table gives one partition per bucket, already distributed by card, so aggregations, windows and joins per card
need no exchange. It also gives one task per bucket, and a card with a third of all rows would put that third into one task. Cards with more
rows than an average bucket are therefore kept in a plain table, whose per-card work shuffles with map-side combining and AQE as usual.
No card is in both tables, so a result per card is the union of the two results (:meth:`CardTable.each`).

Size: a card counts as large if it has more than rows / buckets rows, so there are fewer large cards than buckets; that bounds their broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.session import stored

LARGE = "_large"      # suffix of the table of large cards


def save_by_card(txn: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "cc_num", order: str = "trans_ts") -> CardTable:
    """``saveAsTable`` of ``txn`` as ``table`` (``buckets`` buckets of ``key``, sorted by it) and ``table_large``, replacing both.

    Rows are shuffled once, by bucket, under a ``rebalance`` hint. ``path`` gives the folder of external tables (default: the warehouse).
    Rows with a NULL key are one more card. ``txn`` is read three times (one column for the
    card counts, the rest, the large cards), so give a stored table. Unlike ``write_transactions`` the replacement is not crash-safe.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    counts, _ = stored(txn.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n").alias("_total"))
    # at most buckets - 1 cards: each has over 1 / buckets of all rows
    large = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("_n") * buckets > F.col("_total")).select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    bucket = F.pmod(F.hash(key), F.lit(buckets))          # the bucket that the writer gives a row
    rest = (txn.join(large, same, "left_anti").withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")
               .sortWithinPartitions(bucket, key, order))
    _save(rest.write.bucketBy(buckets, key).sortBy(key, order), table, path)
    hot = txn.join(large, same, "left_semi").hint("rebalance").sortWithinPartitions(key, order)
    _save(hot.write, table + LARGE, path)
    return CardTable(txn.sparkSession, table)


def _save(writer, table: str, path: str | None) -> None:
    if path:
        writer = writer.option("path", f"{path.rstrip('/')}/{table.split('.')[-1]}")
    writer.mode("overwrite").format("parquet").saveAsTable(table)


@dataclass(frozen=True)
class CardTable:
    """A table written by :func:`save_by_card`."""

    spark: SparkSession
    table: str

    def each(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on the rows of each card: on the bucketed table, where it needs no exchange, and on that of the large cards.

        ``work`` must treat each card by itself (group by the card, windows partitioned by it).
        """
        return work(self.spark.table(self.table)).unionByName(work(self.spark.table(self.table + LARGE)))

    @property
    def rows(self) -> DataFrame:
        """All rows."""
        return self.each(lambda rows: rows)
