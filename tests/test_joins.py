"""Bucketed interval join equals the plain equi join + BETWEEN, including boundaries."""

import datetime as dt
import random

import pytest

from ledgerlens.operators.joins import interval_join

T0 = dt.datetime(2020, 3, 1)


def test_boundaries_inclusive(spark):
    left = spark.createDataFrame([(1, T0)], "k long, lt timestamp_ntz")
    right = spark.createDataFrame(
        [(1, T0), (1, T0 + dt.timedelta(hours=24)), (1, T0 + dt.timedelta(hours=24, seconds=1)),
         (1, T0 - dt.timedelta(seconds=1)), (2, T0)], "k long, rt timestamp_ntz")
    got = sorted(r.rt for r in interval_join(left, right, "k", "lt", "rt").collect())
    assert got == [T0, T0 + dt.timedelta(hours=24)]


def test_bucketed_equals_plain(spark):
    rnd = random.Random(5)
    base = T0
    lrows = [(rnd.randrange(5), base + dt.timedelta(seconds=rnd.randrange(10 * 86400))) for _ in range(400)]
    rrows = [(rnd.randrange(5), base + dt.timedelta(seconds=rnd.randrange(10 * 86400))) for _ in range(300)]
    left = spark.createDataFrame(lrows, "k long, lt timestamp_ntz")
    right = spark.createDataFrame(rrows, "k long, rt timestamp_ntz")
    a = interval_join(left, right, "k", "lt", "rt", bucketed=True)
    b = interval_join(left, right, "k", "lt", "rt", bucketed=False)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucket_edges_counted_once(spark):
    # left exactly on a bucket edge, right exactly one horizon later (next bucket edge)
    edge = dt.datetime(2020, 3, 2)  # a multiple of 86400 s since the epoch
    left = spark.createDataFrame([(1, edge), (1, edge - dt.timedelta(seconds=1))], "k long, lt timestamp_ntz")
    right = spark.createDataFrame([(1, edge + dt.timedelta(days=1)), (1, edge)], "k long, rt timestamp_ntz")
    a = interval_join(left, right, "k", "lt", "rt")
    b = interval_join(left, right, "k", "lt", "rt", bucketed=False)
    assert a.count() == b.count() == 3


def test_nearest_pairs_top_k_equals_all_pairs(spark):
    from txn_rows import make_txn
    from ledgerlens.plans.adhoc import fraud_after_large
    rnd = random.Random(11)
    rows = []
    for _ in range(1500):
        card = rnd.choice([1, 1, 1, 2, 3])  # card 1 is hot
        ts = T0 + dt.timedelta(seconds=rnd.randrange(0, 5 * 86400, 600))  # coarse grid -> many ties
        fraud = 1 if rnd.random() < 0.3 else 0
        amt = rnd.choice(["501.00", "750.00", "499.99", "900.00"])
        rows.append(dict(cc_num=card, trans_ts=ts, is_fraud=fraud, amt=amt))
    txn = make_txn(spark, rows)
    for k in (1, 5, 50):
        a = fraud_after_large(txn, k=k, method="nearest")
        b = fraud_after_large(txn, k=k, method="all_pairs")
        assert a.count() == b.count() == k
        assert a.exceptAll(b).count() == 0


def _bursts():
    second, milli = dt.timedelta(seconds=1), dt.timedelta(milliseconds=1)
    legit = lambda ts, amt="600.00", card=1: dict(cc_num=card, trans_ts=ts, is_fraud=0, amt=amt)
    fraud = lambda ts, card=1: dict(cc_num=card, trans_ts=ts, is_fraud=1, amt="5.00")
    a_minute = [legit(T0 + i * second) for i in range(60)] + [fraud(T0 + 61 * second)]
    under_a_second = [legit(T0 + i * 17 * milli, amt) for i in range(70) for amt in ("600.00", "700.00")] + [fraud(T0 + i * 333 * milli) for i in range(9)]
    many_frauds = [legit(T0 + i * second) for i in range(60)] + [fraud(T0 + (60 + i) * second) for i in range(200)]
    over_midnight = [legit(T0 - i * second, card=c) for i in range(40) for c in (1, 2)] + [fraud(T0 + i * 3600 * second, card=c) for i in range(24) for c in (1, 2)]
    return {"a minute": a_minute, "under a second": under_a_second, "many frauds": many_frauds, "over midnight": over_midnight}


@pytest.mark.parametrize("name", sorted(_bursts()))
def test_nearest_pairs_of_a_busy_card_equal_all_pairs(spark, name):
    from txn_rows import make_txn
    from ledgerlens.plans.adhoc import fraud_after_large
    txn = make_txn(spark, _bursts()[name])
    for k in (1, 5, 50):
        got = [tuple(r) for r in fraud_after_large(txn, k=k).collect()]
        assert got == [tuple(r) for r in fraud_after_large(txn, k=k, method="all_pairs").collect()] and len(got) == k


def test_nearest_pairs_is_one_lazy_plan(spark):
    from txn_rows import make_txn
    from ledgerlens.plans.adhoc import fraud_after_large
    df = fraud_after_large(make_txn(spark, _bursts()["a minute"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrderedAndProject" in plan


def test_nearest_pairs_bounded_per_right_row(spark):
    from ledgerlens.operators.joins import nearest_preceding_pairs
    from pyspark.sql import functions as F
    left = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=i), i) for i in range(200)],
                                 "k long, lt timestamp_ntz, v int")
    right = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5))] * 30, "k long, rt timestamp_ntz")
    pairs = nearest_preceding_pairs(left, right, "k", "lt", "rt", 3)
    per_right = pairs.groupBy("rt").count().collect()
    assert pairs.count() == 30 * 3
    assert pairs.agg(F.min("v")).first()[0] == 197  # the three most recent left rows
    assert per_right
