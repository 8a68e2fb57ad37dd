"""Properties of the reports on the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from txn_rows import SF_MID
from ledgerlens.plans import behavior, geography, segmentation, velocity
from ledgerlens.plans.catalog import transactions_from_driver_tables


@pytest.fixture(scope="module")
def txn(spark):
    return transactions_from_driver_tables(spark, SF_MID)


def test_band_counts_sum_to_total(txn):
    total = txn.count()
    for report, col in [(velocity.distance_band_rate, "txn_count"), (velocity.amount_band_rate, "txn_count"),
                        (geography.city_size_rate, "txn_count")]:
        assert report(txn).agg(F.sum(col)).first()[0] == total
    legit = txn.where("is_fraud = 0").count()
    assert segmentation.age_band_spend(txn).agg(F.sum("total_txns")).first()[0] == legit


def test_revenue_shares_sum_to_100_within_rounding(txn):
    rows = segmentation.rfm_segments(txn).collect()
    assert abs(sum(r.pct_of_total_revenue for r in rows) - 100) <= 0.05 * len(rows)
    assert sum(r.cardholders for r in rows) == txn.where("is_fraud = 0").select("cc_num").distinct().count()


def test_expected_counts_use_portfolio_rate(txn):
    rows = velocity.amount_band_rate(txn).collect()
    assert sum(r.actual_fraud for r in rows) == txn.where("is_fraud = 1").count()
    for r in rows:
        assert r.fraud_deficit == r.expected_if_random - r.actual_fraud


def test_offset_pages_through_the_ranking(txn):
    first = behavior.spend_consistency(txn, k=10).collect()
    second = behavior.spend_consistency(txn, k=10, offset=10).collect()
    both = behavior.spend_consistency(txn, k=20).collect()
    assert [r.cc_num for r in first + second] == [r.cc_num for r in both]
