"""The rate reports from stored states, and approximate card counts held against exact ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators.rollup import merged_rate, read_states, write_states
from ledgerlens.plans import adhoc, category, geography, velocity
from ledgerlens.session import scratch_path

# report name -> report(states) -> DataFrame
STATE_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    name: partial(report, rate=merged_rate) for name, report in {
        "category_scorecard": category.category_scorecard,
        "category_loss_priority": category.category_loss_priority,
        "hour_category_pattern": category.hour_category_pattern,
        "distance_band_rate": velocity.distance_band_rate,
        "amount_band_rate": velocity.amount_band_rate,
        "state_risk": geography.state_risk,
        "city_size_rate": geography.city_size_rate,
        "fraud_rate_jumps": adhoc.fraud_rate_jumps,
        "elevated_states": adhoc.elevated_states,
    }.items()
}


def stored_states(txn: DataFrame, distinct: str = "exact") -> DataFrame:
    """The rate states of ``txn``, written to the shared folder and read back."""
    spark: SparkSession = txn.sparkSession
    return read_states(spark, write_states(txn, scratch_path(spark, "states"), distinct), distinct)


def sketched_cards(txn: DataFrame, bound_pct: int = 8) -> DataFrame:
    """Distinct cards per category, state and city size band: the exact number, and whether the estimate from merged
    sketches is within ``bound_pct`` percent (five standard errors of the default sketch) of it."""
    exact, sketch = stored_states(txn), stored_states(txn, "sketch")

    def counts(states: DataFrame, name: str) -> DataFrame:
        parts = [merged_rate(states, [dim], "cc_num").select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), F.col("entities").alias(name))
                 for dim in ("category", "state", "city_size")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    both = counts(exact, "unique_cards").join(counts(sketch, "_estimate").withColumnsRenamed({"dim": "_dim", "value": "_value"}),
                                              (F.col("dim") == F.col("_dim")) & F.col("value").eqNullSafe(F.col("_value")))
    within = F.abs(F.col("_estimate") - F.col("unique_cards")) * 100 <= F.col("unique_cards") * bound_pct
    return both.select("dim", "value", "unique_cards", within.alias("within_bound"))
