"""Look-up layout: the curve, whole rows, and the share of the table that look-ups read."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_rollup import as_set, random_rows
from txn_rows import SF_MID, make_txn

from ledgerlens.plans.catalog import transactions_from_driver_tables
from ledgerlens.plans.operations import BLOOM, lookup_table, merchant_lookup, merchant_months
from ledgerlens.sources import read_transactions, write_transactions
from ledgerlens.sources.skipping import KEY, bin_cuts, rows_scanned, with_zorder, z_order
from ledgerlens.sources.versions import resolve


def interleaved_by_hand(bins, bits):
    digits = "".join("".join(str(b >> level & 1) for b in bins) for level in reversed(range(bits)))
    return int(digits, 2)


def test_key_interleaves_the_bins(spark):
    rows = [(i % 7, f"s{i % 5}", None if i % 11 == 0 else i * 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    cuts = bin_cuts(df, ["a", "b", "c"], 3)
    assert len(cuts["c"]) == 7 and cuts["b"] == ["s1", "s2", "s3", "s4"]
    got = {(r.a, r.b, r.c): r[KEY] for r in with_zorder(df, ["a", "b", "c"], 3).collect()}
    for row in set(rows):
        bins = [0 if v is None else sum(cut <= v for cut in cuts[c]) for c, v in zip("abc", row)]
        assert got[row] == interleaved_by_hand(bins, 3), row


def test_one_value_with_most_rows_is_spread_over_ranges(spark):
    """70 % of the rows share one point of the curve; ``spread_by`` cuts it."""
    df = spark.range(8000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in z_order(df, ["k"], spread_by=["t"], files=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_rows_are_whole_with_nulls_copies_and_no_rows(spark, tmp_path):
    rows = random_rows(300)
    for name, txn in (("some", make_txn(spark, rows + rows[:40] + [{"merchant": None, "cc_num": None, "category": None}])), ("none", make_txn(spark, []))):
        path = str(tmp_path / name)
        for partition_by in ((), ("trans_year", "trans_month")):
            write_transactions(txn, path, partition_by=partition_by, skip_by=("merchant", "cc_num"), bloom=BLOOM)
            back = read_transactions(spark, path)
            assert as_set(back) == as_set(txn) and back.count() == txn.count()
    assert merchant_lookup(make_txn(spark, [])).collect() == []


def test_wrong_columns_and_bits(spark):
    df = spark.range(3)
    for columns, bits in (([], 6), (["id"], 0), (["id"] * 11, 6)):
        with pytest.raises(ValueError):
            with_zorder(df, columns, bits)


def row_groups(folder):
    files = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
    return sum(pq.ParquetFile(f).metadata.num_row_groups for f in files)


def test_look_ups_read_a_small_share(spark, tmp_path):
    """A look-up by merchant, by card or by transaction number reads under a stated share of the rows; the month layout reads all for a merchant."""
    txn = transactions_from_driver_tables(spark, SF_MID).cache()
    total = txn.count()
    group = 64 * 1024
    skipping = lookup_table(txn, str(tmp_path / "skip"), group)
    by_month = read_transactions(spark, write_transactions(txn, str(tmp_path / "month"), row_group_bytes=group))
    no_bloom = lookup_table(txn, str(tmp_path / "order"), group, bloom={})
    assert row_groups(resolve(spark, str(tmp_path / "skip"))) > 40
    some = txn.where("is_fraud = 1").orderBy("trans_num").first()

    def share(table, column):
        found = table.where(F.col(column) == some[column])
        assert as_set(found) == as_set(txn.where(F.col(column) == some[column]))
        found = found.select("amt", column)
        found.collect()
        return rows_scanned(found) / total

    assert share(skipping, "merchant") < 0.25 and share(skipping, "cc_num") < 0.5
    # the order says nothing about transaction numbers: their bloom filters do
    assert share(skipping, "trans_num") < 0.05 < 0.3 < share(no_bloom, "trans_num")
    assert share(by_month, "merchant") > 0.9
    months = merchant_months(skipping, some["merchant"])
    assert as_set(months) == as_set(merchant_months(txn, some["merchant"]))


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr("ledgerlens.sources.skipping.RANGE_ROWS", 500)
    for rows in (4000, 8000):
        df = spark.range(rows).withColumn("k", F.col("id") % 900)
        sizes = [r["count"] for r in z_order(df, ["k"], spread_by=["id"]).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == rows // 500 and sum(sizes) == rows and max(sizes) < 1000


def test_bins_are_found_by_compiled_code(spark):
    df = spark.createDataFrame([(i % 50, f"m{i % 30}") for i in range(500)], "a int, b string")
    plan = with_zorder(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "aggregate(" not in plan


def test_facts_of_the_look_up_are_stored_without_a_sort(spark, monkeypatch):
    from ledgerlens.plans import operations
    from ledgerlens.sources.sinks import layout_for_write
    plans = []

    def seen(df, path, **layout):
        plans.append(layout_for_write(df, **layout)._jdf.queryExecution().optimizedPlan().toString())
        return write_transactions(df, path, **layout)
    monkeypatch.setattr(operations, "write_transactions", lambda df, path, **layout: write_transactions(df, path, **layout) if "skip_by" in layout else seen(df, path, **layout))
    txn = make_txn(spark, random_rows(200))
    assert merchant_lookup(txn).count() > 0
    assert len(plans) == 1 and "Sort" not in plans[0] and "Rebalance" not in plans[0]
