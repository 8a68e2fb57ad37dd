"""Exhaustive check of the RFM rules over all 64 (r, f, m) cells."""

import itertools

from pyspark.sql import functions as F

from ledgerlens.functions import rfm_action, rfm_segment, rfm_sub_segment
from ledgerlens.functions import rfm as R


def _segment(r, f, m):
    if r >= 3 and f >= 3 and m >= 3:
        return R.CHAMPIONS
    if r >= 3 and f >= 2:
        return R.LOYAL
    if r >= 3 and f < 2:
        return R.PROMISING
    if r < 2 and f >= 3:
        return R.AT_RISK
    if r < 2 and f < 2:
        return R.LOST
    return R.NEEDS_ATTENTION


def test_all_64_cells(spark):
    cells = list(itertools.product(range(1, 5), repeat=3))
    df = spark.createDataFrame(cells, "r int, f int, m int")
    seg = rfm_segment("r", "f", "m")
    rows = df.select("r", "f", "m", seg.alias("s"),
                     rfm_sub_segment(seg, "r", "f", "m").alias("sub"),
                     rfm_action(seg, "r", "f", "m").alias("act")).collect()
    assert len(rows) == 64
    for row in rows:
        want = _segment(row.r, row.f, row.m)
        assert row.s == want
        if want != R.NEEDS_ATTENTION:
            assert row.sub == want and row.act == R.ACTION_STANDARD
        else:
            assert row.r <= 2  # every r >= 3 cell is caught by the first three rules
    subs = {row.sub for row in rows}
    acts = {row.act for row in rows}
    # Two branches can never fire because 'Needs Attention' implies r <= 2.
    assert R.ACTIVE_LOW_SPENDER not in subs
    assert R.ACTION_SPEND_MORE not in acts
    assert {R.HIGH_VALUE_GONE_QUIET, R.PLATEAU, R.FREQUENT_SMALL_TICKET, R.MIXED_SIGNALS} <= subs


def test_action_follows_sub_segment_for_needs_attention(spark):
    cells = list(itertools.product(range(1, 5), repeat=3))
    df = spark.createDataFrame(cells, "r int, f int, m int")
    seg = rfm_segment("r", "f", "m")
    pairs = {(r.sub, r.act) for r in df.select(rfm_sub_segment(seg, "r", "f", "m").alias("sub"),
                                               rfm_action(seg, "r", "f", "m").alias("act"),
                                               seg.alias("s")).where(F.col("s") == R.NEEDS_ATTENTION).collect()}
    by_sub = {}
    for sub, act in pairs:
        by_sub.setdefault(sub, set()).add(act)
    assert all(len(v) == 1 for v in by_sub.values())
    assert by_sub[R.HIGH_VALUE_GONE_QUIET] == {R.ACTION_WIN_BACK}
    assert by_sub[R.PLATEAU] == {R.ACTION_MONITOR}
    assert by_sub[R.FREQUENT_SMALL_TICKET] == {R.ACTION_UPGRADE}
    assert by_sub[R.MIXED_SIGNALS] == {R.ACTION_REVIEW}
