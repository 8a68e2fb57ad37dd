"""Hand-made tables for the semantic traps of the reports."""

import datetime as dt
from decimal import Decimal

from txn_rows import make_txn
from ledgerlens.operators.alerts import absolute_rules, hourly_profile
from ledgerlens.plans import adhoc, behavior, segmentation
from ledgerlens.plans.preparation import prepare_transactions, sanity_profile
from ledgerlens.schema import RAW_COLUMNS, TRANSACTION_COLUMNS

T = dt.datetime


def test_prepare_casts_union_and_null_name(spark):
    base = dict(trans_date_trans_time="2019-03-09 23:05:07", cc_num=7, merchant="m", category="misc_net",
                amt=Decimal("12.34"), first="Ann", last="Lee", gender="F", city="c", state="S", city_pop=10,
                job="j", dob="1988-03-09", trans_num="a", lat=40.0, long=-75.0, merch_lat=40.5, merch_long=-75.5,
                is_fraud=1)
    a = spark.createDataFrame([tuple(base[c] for c in RAW_COLUMNS)], ", ".join(
        f"{c} {t}" for c, t in zip(RAW_COLUMNS, ["string", "long", "string", "string", "decimal(12,2)", "string",
                                                 "string", "string", "string", "string", "long", "string",
                                                 "string", "string", "double", "double", "double", "double",
                                                 "int"])))
    b_vals = {**base, "last": None, "trans_num": "b"}
    b = a.limit(0).unionByName(spark.createDataFrame([tuple(b_vals[c] for c in RAW_COLUMNS)], a.schema)) \
        .select(*reversed(RAW_COLUMNS))  # other column order
    out = prepare_transactions(a, b).orderBy("trans_num").collect()
    assert [r.trans_num for r in out] == ["a", "b"]
    r = out[0]
    assert r.trans_ts == T(2019, 3, 9, 23, 5, 7) and r.trans_date == dt.date(2019, 3, 9)
    assert (r.trans_year, r.trans_month, r.trans_hour) == (2019, 3, 23)
    assert r.dob == dt.date(1988, 3, 9) and r.age == 32
    assert r.customer_name == "Ann Lee" and out[1].customer_name is None  # NULL part -> NULL name
    assert 60 < r.dist_km < 80
    assert prepare_transactions(a, b).columns == TRANSACTION_COLUMNS


def test_sanity_profile(spark):
    txn = make_txn(spark, [dict(cc_num=1, merchant="a", is_fraud=1), dict(cc_num=2, merchant="a"),
                           dict(cc_num=2, merchant="b", trans_ts=T(2020, 2, 1))])
    r = sanity_profile(txn).first()
    assert (r.total_rows, r.unique_cards, r.unique_merchants, r.fraud_rate_pct) == (3, 2, 2, 33.33)
    assert (r.earliest_txn, r.latest_txn) == (dt.date(2020, 1, 1), dt.date(2020, 2, 1))


def test_hourly_rules_thresholds_and_online_pattern(spark):
    rows = []
    for i in range(8):  # 8 txns, 5 merchants, 'net' (not online by LIKE '%_net')
        rows.append(dict(cc_num=1, category="net", merchant=f"m{i % 5}", trans_ts=T(2020, 1, 1, 10, i)))
    for i in range(7):  # 7 txns, online category 'xnet' matches '%_net'
        rows.append(dict(cc_num=2, category="xnet", merchant=f"m{i}", trans_ts=T(2020, 1, 1, 22, i)))
    h = absolute_rules(hourly_profile(make_txn(spark, rows))).orderBy("cc_num").collect()
    assert (h[0].txns_in_hour, h[0].distinct_merchants, h[0].inperson_txns) == (8, 5, 8)
    assert (h[0].flag_extreme_velocity, h[0].flag_merchant_scatter, h[0].flag_night_burst) == (1, 1, 0)
    assert (h[1].txns_in_hour, h[1].inperson_txns) == (7, 0)
    assert (h[1].flag_extreme_velocity, h[1].flag_merchant_scatter, h[1].flag_night_burst) == (0, 0, 1)
    assert h[0].rules_triggered == 2 and h[1].rules_triggered == 1


def test_fraud_after_large_boundaries(spark):
    t = T(2020, 5, 1, 8, 0, 0)
    rows = [
        dict(cc_num=1, amt="500.01", trans_ts=t),                       # large legit
        dict(cc_num=1, amt="500.00", trans_ts=t),                       # exactly 500: not large
        dict(cc_num=1, is_fraud=1, trans_ts=t),                         # simultaneous: qualifies
        dict(cc_num=1, is_fraud=1, trans_ts=t + dt.timedelta(hours=24)),  # exactly 24 h: qualifies
        dict(cc_num=1, is_fraud=1, trans_ts=t + dt.timedelta(hours=24, seconds=1)),
        dict(cc_num=2, is_fraud=1, trans_ts=t),                         # other card
    ]
    got = adhoc.fraud_after_large(make_txn(spark, rows)).collect()
    assert [(r.cc_num, r.hours_between, r.legit_amt) for r in got] == [(1, 0.0, 500.01), (1, 24.0, 500.01)]


def test_rolling_decline_gap_and_fraud_only_month(spark):
    rows = [dict(cc_num=1, amt="300.00", trans_ts=T(2020, 1, 5)),
            dict(cc_num=1, amt="300.00", trans_ts=T(2020, 2, 5)),
            dict(cc_num=1, amt="300.00", trans_ts=T(2020, 3, 5)),
            # gap in April; May has fraud only -> legit spend 0 for May
            dict(cc_num=1, amt="999.00", is_fraud=1, trans_ts=T(2020, 5, 5)),
            dict(cc_num=2, amt="100.00", trans_ts=T(2020, 5, 6))]
    trend = segmentation.card_month_trend(make_txn(spark, rows)).where("cc_num = 1").orderBy("month_seq").collect()
    assert [float(r.legit_spend) for r in trend] == [300.0, 300.0, 300.0, 0.0]
    assert [r.trend_label for r in trend][0] == "Building history"
    # May: rolling over the last 3 *active* months (Feb, Mar, May) = 200 vs 300 -> <= 0.70 -> urgent
    assert float(trend[-1].rolling_3m_avg) == 200.0 and trend[-1].trend_label == "URGENT: >30% rolling decline"
    out = segmentation.rolling_spend_decline(make_txn(spark, rows)).collect()
    assert [(r.cc_num, r.retention_priority_rank) for r in out] == [(1, 1)]


def test_consistency_null_cv_is_erratic_and_min_periods(spark):
    rows = [dict(cc_num=1, amt="0.00", trans_ts=T(2020, m, 1)) for m in (1, 2, 3)]
    rows += [dict(cc_num=2, amt="10.00", trans_ts=T(2020, m, 1)) for m in (1, 2)]  # only 2 months
    rows += [dict(cc_num=3, amt=a, trans_ts=T(2020, m, 1)) for m, a in ((1, "100"), (2, "100"), (3, "130"))]
    out = {r.cc_num: r for r in behavior.spend_consistency(make_txn(spark, rows)).collect()}
    assert set(out) == {1, 3}
    assert out[1].spend_cv is None and out[1].spend_pattern == "Erratic"
    assert out[3].spend_pattern == "Consistent" and out[3].active_months == 3


def test_month_over_month_uses_previous_existing_row(spark):
    rows = [dict(category="c", amt="100", trans_ts=T(2020, 1, 1)),
            dict(category="c", amt="150", trans_ts=T(2020, 3, 1))]  # February missing
    out = segmentation.category_mom_growth(make_txn(spark, rows)).collect()
    assert [(r.trans_month, r.prev_month_spend, r.mom_growth_pct) for r in out] == [(1, None, None),
                                                                                     (3, 100.0, 50.0)]


def test_expected_counts_at_a_given_rate(spark):
    from ledgerlens.operators.rates import expected_vs_actual
    counts = spark.createDataFrame([("a", 1000, 20), ("b", 3000, 30)], "band string, txn_count long, actual_fraud long")
    own = {r.band: r.expected_if_random for r in expected_vs_actual(counts).collect()}
    given = {r.band: (r.expected_if_random, r.fraud_deficit) for r in expected_vs_actual(counts, base_rate="2.5").collect()}
    assert own == {"a": 13.0, "b": 38.0} and given == {"a": (25.0, 5.0), "b": (75.0, 45.0)}


def test_rolling_trend_of_the_last_period_only(spark):
    from ledgerlens.operators.series import rolling_trend
    rows = [(c, m, Decimal(v)) for c, m, v in [(1, 1, "100.00"), (1, 2, "10.00"), (1, 3, "1.00"), (2, 1, "5.00"), (2, 2, "6.00"), (3, 3, "7.00")]]
    df = spark.createDataFrame(rows, "c int, m int, v decimal(12,2)")
    whole = rolling_trend(df, ["c"], ["m"], "v")
    last = rolling_trend(df, ["c"], ["m"], "v", last_only=True)
    assert last.columns == whole.columns and sorted(last.collect()) == sorted(whole.where("m = 3").collect()) and last.count() == 2


def test_deviation_is_exact_on_close_values(spark):
    from ledgerlens.operators.series import consistency
    rows = [(1, Decimal(f"{10**9}.{i:02d}")) for i in (11, 12, 13)]
    r = consistency(spark.createDataFrame(rows, "k int, v decimal(12,2)"), ["k"], "v").first()
    assert r["_sd"] == 0.01
