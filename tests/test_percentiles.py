"""Percentiles from counts of values, against sorting the values of each group."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators.percentiles import percentile_by, percentile_digits
from test_alerts import interpolated
from txn_rows import make_txn

SCHEMA = "k string, n long, v decimal(12,2)"


def by_sorting(rows, q):
    """{group: (percentile of n, percentile of v)}, groups without any value left out."""
    n, v = defaultdict(list), defaultdict(list)
    for k, a, b in rows:
        if a is not None:
            n[k].append(Fraction(a))
        if b is not None:
            v[k].append(Fraction(b))
    return {k: tuple(interpolated(of[k], q) if k in of else None for of in (n, v)) for k in set(n) | set(v)}


def by_counts(spark, rows, q):
    got = percentile_by(spark.createDataFrame(rows, SCHEMA), ["k"], {"pn": "n", "pv": "v"}, q)
    return {r.k: tuple(None if x is None else Fraction(x) for x in (r.pn, r.pv)) for r in got.collect()}


money = st.integers(-10 ** 9, 10 ** 9).map(lambda c: Decimal(c) / 100)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(-3, 3), st.none() | money), max_size=40),
       st.sampled_from([0, 0.25, 0.5, 0.9, 0.99, 0.125, 1]))
def test_equals_sorting(spark, rows, q):
    assert by_counts(spark, rows, q) == by_sorting(rows, q)


def test_one_group_with_most_rows_and_one_value_with_most_of_those(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}", 7 if rnd.random() < 0.7 else rnd.randrange(20), Decimal(rnd.randrange(10 ** 6)) / 100) for _ in range(6000)]
    for q in (0.1, 0.9, 0.9999):
        assert by_counts(spark, rows, q) == by_sorting(rows, q)


def test_rows_of_a_hot_group_are_counted_before_they_are_shuffled(spark):
    """Ten thousand rows of one group with five values: the exchange carries five counts for each input partition."""
    rows = spark.range(0, 10_000, 1, 4).select(F.lit("hot").alias("k"), (F.col("id") % 5).alias("v"))
    found = percentile_by(rows, ["k"], {"p": "v"}, 0.9, 0)
    assert [tuple(r) for r in found.collect()] == [("hot", Decimal("4.0"))]
    written = shuffled(found)
    assert written and max(written) <= 20


def shuffled(df):
    """Rows that each exchange of the executed plan wrote."""
    out = []

    def walk(node):
        if node.metrics().contains("shuffleRecordsWritten"):
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_empty_input_and_wrong_shares(spark):
    assert by_counts(spark, [], 0.9) == {}
    assert by_counts(spark, [("a", None, None)], 0.9) == {}
    assert percentile_digits(0.9) == 3 and percentile_digits(1) == 2
    for q in (-0.1, 1.1, 0.12345):
        with pytest.raises(ValueError):
            percentile_by(make_txn(spark, []), ["cc_num"], {"p": "amt"}, q)
