"""Sinks: materialise the prepared table (create-table-as / replace)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import TRANSACTION_COLUMNS, TRANSACTIONS_SCHEMA
from ledgerlens.sources.skipping import bloom_options, z_order
from ledgerlens.sources.versions import replace, resolve


def write_transactions(df: DataFrame, path: str, partition_by: Sequence[str] = ("trans_year", "trans_month"),
                       cluster_by: Sequence[str] = ("cc_num", "trans_ts"), keep: int = 2,
                       skip_by: Sequence[str] = (), bloom: Mapping[str, int] | None = None, row_group_bytes: int | None = None) -> str:
    """Write the prepared table as Parquet, replacing any previous version.

    The replacement is crash-safe (see :mod:`ledgerlens.sources.versions`): a new folder is written under ``path`` and becomes the
    table when it is complete, so ``df`` may read the table that it replaces. ``keep`` versions stay on storage.

    Layout for scale: one directory per year/month (date pruning on the
    partition columns), rows clustered by card and time inside each file so
    Parquet min/max statistics skip row groups on card or time predicates.
    The ``rebalance`` hint groups rows by the partition columns but lets AQE
    split an oversized month (or a month dominated by one hot card) into
    several tasks and files, and merge small ones. The local sort rides on that
    shuffle; there is no global sort.

    For look-ups by other columns, ``skip_by`` orders the rows along a space-filling curve over them instead, and ``bloom`` (column:
    distinct values expected in a row group) writes bloom filters; see :mod:`ledgerlens.sources.skipping`. ``row_group_bytes`` sets the unit of skipping.
    ``df`` is then read three times (samples for the bins and for the ranges, and the write), so give a stored table.
    """
    w = layout_for_write(df, partition_by, cluster_by, skip_by).write.options(**bloom_options(bloom or {}, row_group_bytes))
    if partition_by:
        w = w.partitionBy(*partition_by)
    replace(df.sparkSession, path, w.parquet, keep)
    return path


def layout_for_write(df: DataFrame, partition_by: Sequence[str] = ("trans_year", "trans_month"),
                     cluster_by: Sequence[str] = ("cc_num", "trans_ts"), skip_by: Sequence[str] = ()) -> DataFrame:
    """Rows grouped by the partition columns (AQE-rebalanced) and sorted locally by
    partition + cluster columns, ready for a partitioned Parquet write; with ``skip_by``
    in ranges of the partition columns and a space-filling curve over ``skip_by``."""
    if skip_by:
        return z_order(df, skip_by, partition_by, cluster_by)
    out = df
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if cluster_by:
        out = out.sortWithinPartitions(*partition_by, *cluster_by)
    return out


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Read a prepared table written by :func:`write_transactions` (columns in canonical order, types as declared; a table without rows has no file to tell them)."""
    return spark.read.schema(TRANSACTIONS_SCHEMA).parquet(resolve(spark, path)).select(*TRANSACTION_COLUMNS)
