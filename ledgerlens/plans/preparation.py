"""S0a / S0b: build the prepared transaction table and profile it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import age_at, great_circle_km, pct
from ledgerlens.sources.raw import conform_raw

AGE_AS_OF = "2020-12-31"


def prepare_transactions(*raw_tables: DataFrame, age_as_of: str = AGE_AS_OF) -> DataFrame:
    """Combine raw exports by column name and derive the 24-column prepared table.

    Casts the event time and birth date, derives calendar fields, age at
    ``age_as_of``, the display name (NULL if either part is NULL) and the
    home-to-merchant distance. One narrow projection per input split: no
    shuffle; write it once with :func:`ledgerlens.sources.write_transactions`.
    """
    if not raw_tables:
        raise ValueError("at least one raw table is required")
    combined = conform_raw(reduce(lambda a, b: a.unionByName(b), raw_tables))
    ts = F.col("trans_date_trans_time").cast("timestamp_ntz")
    dob = F.col("dob").cast("date")
    return combined.select(
        F.col("trans_num"),
        F.col("cc_num"),
        ts.alias("trans_ts"),
        ts.cast("date").alias("trans_date"),
        F.year(ts).alias("trans_year"),
        F.month(ts).alias("trans_month"),
        F.hour(ts).alias("trans_hour"),
        dob.alias("dob"),
        age_at(dob, age_as_of).alias("age"),
        F.col("merchant"),
        F.col("category"),
        F.col("amt"),
        F.concat(F.col("first"), F.lit(" "), F.col("last")).alias("customer_name"),
        F.col("gender"),
        F.col("city"),
        F.col("state"),
        F.col("city_pop"),
        F.col("job"),
        F.col("lat"),
        F.col("long"),
        F.col("merch_lat"),
        F.col("merch_long"),
        F.col("is_fraud"),
        great_circle_km("lat", "long", "merch_lat", "merch_long").alias("dist_km"),
    )


def sanity_profile(txn: DataFrame) -> DataFrame:
    """S0b: one row with row count, distinct cards and merchants, fraud %, date range."""
    return txn.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("cc_num").alias("unique_cards"),
        F.countDistinct("merchant").alias("unique_merchants"),
        pct(F.sum("is_fraud"), F.count(F.lit(1)), 2).alias("fraud_rate_pct"),
        F.min("trans_date").alias("earliest_txn"),
        F.max("trans_date").alias("latest_txn"),
    )
