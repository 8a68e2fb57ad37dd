"""The table laid out by card: whole rows, no exchange per card, large cards apart."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import Window, functions as F
from test_rollup import as_set, random_rows
from txn_rows import SF_SMALL, make_txn

from ledgerlens.operators.alerts import hourly_profile, with_baseline
from ledgerlens.operators.rfm import rfm_base
from ledgerlens.operators.series import cohort_matrix
from ledgerlens.plans.catalog import transactions_from_driver_tables
from ledgerlens.plans.segmentation import RFM_KEYS, card_month_trend
from ledgerlens.sources.bucketed import LARGE, save_by_card


def name():
    return f"cards_{uuid.uuid4().hex[:12]}"


def card_exchanges(df):
    """Exchanges on the card in the plan as it will first run."""
    return re.findall(r"Exchange hashpartitioning\(cc_num[^\n]*", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def cards(spark, tmp_path_factory):
    return save_by_card(transactions_from_driver_tables(spark, SF_SMALL).cache(), name(), 4, str(tmp_path_factory.mktemp("cards")))


def test_rows_are_whole(spark, cards):
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    assert as_set(cards.rows.select(*txn.columns)) == as_set(txn)
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {cards.table}").collect()}
    assert detail["Num Buckets"] == "4" and detail["Bucket Columns"] == "[`cc_num`]" and detail["Sort Columns"] == "[`cc_num`, `trans_ts`]"


@pytest.mark.parametrize("work", [
    lambda t: rfm_base(t, RFM_KEYS, as_of="2021-01-01"),
    lambda t: card_month_trend(t),
    lambda t: with_baseline(hourly_profile(t, keep_null_keys=True)),
    lambda t: t.groupBy("cc_num").agg(F.count(F.lit(1)).alias("n")).join(t.where("is_fraud = 1").groupBy("cc_num").agg(F.sum("amt").alias("lost")), "cc_num"),
    lambda t: t.withColumn("nth", F.row_number().over(Window.partitionBy("cc_num").orderBy("trans_ts", "trans_num"))),
], ids=["rfm_base", "card_month_trend", "baseline", "join", "window"])
def test_per_card_work_needs_no_exchange(spark, cards, work):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = transactions_from_driver_tables(spark, SF_SMALL)
        assert card_exchanges(work(plain))
        bucketed = work(spark.table(cards.table))
        assert not card_exchanges(bucketed), bucketed._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in bucketed._jdf.queryExecution().executedPlan().toString() or "SelectedBucketsCount" in \
            bucketed._jdf.queryExecution().executedPlan().toString()
        assert as_set(cards.each(work)) == as_set(work(plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_cohorts_exchange_no_rows_by_card(spark, cards):
    def of(each):
        return cohort_matrix(cards.rows, each=each)

    bucketed_side = cohort_matrix(spark.table(cards.table))
    assert not card_exchanges(bucketed_side)
    assert as_set(of(cards.each)) == as_set(of(None))


def test_a_card_with_a_third_of_all_rows_is_kept_apart(spark, tmp_path):
    txn = make_txn(spark, random_rows(900)).cache()            # card 0: a third and more; null is a card too
    cards = save_by_card(txn, name(), 8, str(tmp_path))
    large = {r.cc_num for r in spark.table(cards.table + LARGE).select("cc_num").distinct().collect()}
    assert large == {0}
    assert spark.table(cards.table).where("cc_num IS NOT DISTINCT FROM 0").count() == 0
    assert spark.table(cards.table).where("cc_num IS NULL").count() == txn.where("cc_num IS NULL").count() > 0

    def count(rows):
        return rows.groupBy("cc_num").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("spend"))

    assert as_set(cards.each(count)) == as_set(count(txn))


def test_a_large_null_card_and_a_second_write(spark, tmp_path):
    table = name()
    first = make_txn(spark, [{"trans_num": str(i), "cc_num": None if i % 2 else i} for i in range(80)])
    cards = save_by_card(first, table, 4, str(tmp_path))
    assert spark.table(table + LARGE).where("cc_num IS NULL").count() == 40 == spark.table(table + LARGE).count()
    second = make_txn(spark, [{"trans_num": str(i), "cc_num": i} for i in range(10)])
    cards = save_by_card(second, table, 4, str(tmp_path))
    assert cards.rows.count() == 10 and spark.table(table + LARGE).count() == 0
    cards = save_by_card(second, table, 16, str(tmp_path))             # fewer cards than buckets: each is above the average
    assert cards.rows.count() == 10 == spark.table(table + LARGE).count()


def test_no_rows_and_no_buckets(spark, tmp_path):
    cards = save_by_card(make_txn(spark, []), name(), 4, str(tmp_path))
    assert cards.rows.count() == 0
    assert cards.each(lambda t: t.groupBy("cc_num").count()).collect() == []
    with pytest.raises(ValueError):
        save_by_card(make_txn(spark, []), name(), 0, str(tmp_path))
