"""Grouped label-rate aggregates, expectation vs. actual, ranking and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.numeric import cond_sum, dec, pct_exact, safe_div


def label_rate(df: DataFrame, dims: Sequence, label: str = "is_fraud", amount: str = "amt",
               entity: str | None = None, extra: Sequence[Column] = (), sketch_lg_k: int | None = None) -> DataFrame:
    """One pass of exact base aggregates per group.

    Columns: ``n`` (rows), ``label_n`` (sum of the 0/1 label), ``volume`` (sum of
    amount), ``loss`` (amount of labelled rows) and, if ``entity`` is given,
    ``entities`` (distinct non-NULL entities). Reports derive rates, means and
    flags from these. Partial aggregation runs map-side, so a hot group costs
    one row per input split in the shuffle. Distinct entities are exact, which shuffles each
    (group, entity) once, unless ``sketch_lg_k`` (4..21) asks for an estimate by a HyperLogLog sketch of 2^lg_k registers
    (relative standard error 1.04 / sqrt(2^lg_k)), which shuffles one sketch per group and input split.
    """
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("long").alias("label_n"),
        F.sum(amount).alias("volume"),
        cond_sum(F.col(label) == 1, amount).alias("loss"),
    ]
    if entity:
        found = F.countDistinct(entity) if sketch_lg_k is None else F.hll_sketch_estimate(F.hll_sketch_agg(entity, F.lit(sketch_lg_k)))
        aggs.append(found.alias("entities"))
    return df.groupBy(*dims).agg(*aggs, *extra)


def expected_vs_actual(counts: DataFrame, n: str = "txn_count", actual: str = "actual_fraud",
                       rate_digits: int = 4, base_rate=None) -> DataFrame:
    """Compare each group's label count with the portfolio-wide rate.

    The portfolio rate (percent, rounded to ``rate_digits``) is ``base_rate`` if given, else the ratio of the
    column totals of ``counts``; ``counts`` is already aggregated to one row per
    band, so the total is a window over a handful of rows.
    """
    whole = Window.partitionBy()
    total = pct_exact(F.sum(actual).over(whole), F.sum(n).over(whole), rate_digits)
    rate = (total if base_rate is None else F.round(dec(base_rate), rate_digits)).cast(f"decimal(10,{rate_digits})")
    expected_raw = F.col(n).cast("decimal(20,0)") * F.col("_rate") / dec("100.0")
    expected = F.round(expected_raw, 0)
    return (counts.withColumn("_rate", rate)
            .withColumn("_expected_raw", expected_raw)
            .withColumn("expected_if_random", expected.cast("double"))
            .withColumn("fraud_deficit", (expected - F.col(actual)).cast("double"))
            .withColumn("pct_below_expected",
                        F.round((dec("1.0") - safe_div(F.col(actual).cast("decimal(20,0)"), F.col("_expected_raw")))
                                * dec("100.0"), 0).cast("double"))
            .drop("_rate", "_expected_raw"))


def rank_by(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC)`` over an aggregate, e.g. a ratio of sums.

    Meant for already aggregated frames with a bounded number of groups
    (categories); rank large frames with :func:`ledgerlens.operators.global_rank`."""
    return df.withColumn(name, F.rank().over(Window.orderBy(value.desc())))


def top_k(df: DataFrame, k: int, order: Sequence[Column], offset: int = 0) -> DataFrame:
    """``ORDER BY ... [OFFSET offset ROWS] FETCH NEXT k ROWS``; planned as
    TakeOrderedAndProject (offset + k rows per task, merged). ``order`` should
    end in a unique tail so the cut is deterministic."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(k)
