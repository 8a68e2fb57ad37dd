"""Distributed NTILE / RANK equal the built-in single-partition windows."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import Row, Window, functions as F

from ledgerlens.operators.ranking import _Cut, cut_rows, global_ntile, global_rank, with_tiles
from ledgerlens.session import ensure_checkpoint_dir, stored


def _data(spark, n, distinct, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(distinct) if rnd.random() < 0.95 else None, rnd.randrange(3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v long, g int")


def _files(spark):
    # the library's own scratch files; the session's cleaner removes other checkpoints at any time
    folder = re.sub("^file:/*", "/", ensure_checkpoint_dir(spark)) + "/ledgerlens"
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize(("n", "k", "descending"), [(0, 4, True), (1, 4, True), (3, 4, False), (10, 4, True), (1001, 4, False), (997, 7, True)])
def test_ntile_equals_builtin(spark, n, k, descending):
    df = _data(spark, n, 50, n)
    got = global_ntile(df, k, [("v", descending), ("id", False)], "t")
    order = [F.col("v").desc() if descending else F.col("v").asc(), F.col("id").asc()]
    want = df.withColumn("t", F.ntile(k).over(Window.orderBy(*order)))
    assert sorted(map(tuple, got.select("id", "t").collect())) == sorted(map(tuple, want.select("id", "t").collect()))


def test_ntile_on_a_heavy_value_and_other_types(spark):
    # one value holds most rows; keys of several types, nulls among them
    rnd = random.Random(9)
    rows = [(i, Decimal("1.00") if rnd.random() < 0.7 else Decimal(rnd.randrange(10**5)) / 100, rnd.choice(["a", "b", None]), dt.date(2020, 1, 1 + rnd.randrange(3))) for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, v decimal(12,2), s string, d date").repartition(7)
    keys = [("v", False), ("s", True), ("d", False), ("id", False)]
    got = global_ntile(df, 4, keys, "t")
    want = df.withColumn("t", F.ntile(4).over(Window.orderBy("v", F.col("s").desc(), "d", "id")))
    assert got.select("id", "t").exceptAll(want.select("id", "t")).count() == 0
    assert sorted(r["count"] for r in got.groupBy("t").count().collect()) == [5000] * 4


def test_cuts_come_from_shared_passes_and_the_result_is_a_projection(spark):
    df = _data(spark, 500, 10, 2)
    before = _files(spark)
    got = with_tiles(df, 4, {"t": [("v", False), ("id", False)], "u": [("g", True), ("id", True)]})
    assert _files(spark) == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Window|Join|Sort", plan) and plan.count("Scan") == 1
    kept, rows = stored(df)
    assert rows == 500 and len(cut_rows(kept, {"t": [("v", False), ("id", False)]}, 4, rows)["t"]) == 3


@pytest.mark.parametrize("sample", [100, 2000])
def test_brackets_shrink_to_the_exact_rows(spark, sample):
    # 70 % of the rows hold one value, a third of all are one identical row
    rnd = random.Random(sample)
    rows = [(7, "hot", 1.0)] * 4000 + [(7 if rnd.random() < 0.55 else rnd.randrange(1000), rnd.choice(["a", "b", None, "é"]), rnd.choice([float("nan"), None, rnd.random()])) for _ in range(8000)]
    df, n = stored(spark.createDataFrame(rows, "v long, s string, x double").repartition(5))
    orders = {"a": [("v", False), ("s", True), ("x", False)], "b": [("x", True), ("s", False), ("v", True)], "c": [("s", False), ("v", False), ("x", True)]}
    got = cut_rows(df, orders, 5, n, sample)
    for name, order in orders.items():
        ranked = df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order]).collect()
        assert [str({k: c[k] for k, _ in order}) for c in got[name]] == [str({k: ranked[n // 5 * t + min(t, n % 5) - 1][k] for k, _ in order}) for t in range(1, 5)]


def test_a_missed_bracket_is_replaced_by_the_side_that_the_counts_name():
    order, low, high = [("v", False)], Row(v=10), Row(v=20)
    cut = _Cut(order, 50, 100, 5, low, high)
    cut.take(60, 1, 5, 1, [], complete=False)
    assert (cut.low, cut.high, cut.rows, cut.found) == (None, low, 60, None)
    cut = _Cut(order, 50, 100, 30, low, high)
    cut.take(20, 1, 5, 1, [], complete=True)
    assert (cut.low, cut.high, cut.rows, cut.found) == (high, None, 73, None)
    cut.take(26, 1, 73, 0, [Row(v=21 + i) for i in range(73)], complete=True)
    assert cut.found == Row(v=43)
    for counts, want in (((40, 10, 9, 9), low), ((40, 9, 0, 1), high)):
        cut = _Cut(order, 50, 100, 30, low, high)
        cut.take(*counts, [], complete=False)
        assert cut.found == want


@pytest.mark.parametrize(("n", "distinct"), [(0, 5), (1, 5), (1500, 20), (1500, 100000), (1500, 1)])
def test_rank_equals_builtin_with_ties_and_nulls(spark, n, distinct):
    df = _data(spark, n, distinct, 3)
    got = global_rank(df, [("g", False), ("v", True)], "rk")
    want = df.withColumn("rk", F.rank().over(Window.orderBy(F.col("g").asc(), F.col("v").desc())))
    assert sorted(map(str, got.select("id", "rk").collect())) == sorted(map(str, want.select("id", "rk").collect()))


def test_rank_puts_one_row_per_partition_in_one_task(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    df = _data(spark, 800, 300, 5).withColumn("id", counted("id"))
    got = global_rank(df, [("g", False), ("v", True)], "rk")
    got.collect()
    # the input is evaluated once, and only the offsets pass through one task
    assert seen.value == 800
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2  # the offset table, shown in the final and the initial plan
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert any("_pid" in w.split("windowspecdefinition")[1].split("ASC")[0] for w in windows)


def test_decline_report_reads_the_facts_twice_at_most(spark, tmp_path):
    # the facts are read while the report is built: two evaluations (trend, latest month), none in the result
    import datetime as dt
    from txn_rows import make_txn
    from ledgerlens.plans.segmentation import rolling_spend_decline
    rows = [dict(cc_num=c, trans_ts=dt.datetime(2020, m, 5), amt=1000 // m ** 2 + c) for c in range(30) for m in range(1, 8)]
    got = rolling_spend_decline(make_txn(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" in plan
    ranks = [r.retention_priority_rank for r in got.collect()]
    assert len(ranks) == 30 and ranks[0] == 1 and max(ranks) <= 30
