"""Queries that exercise single operators, readers and the sink: replace, load with rejects, baselines, interval pairs, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.calendar import epoch_second
from ledgerlens.operators.alerts import hourly_profile, personal_baseline
from ledgerlens.operators.joins import interval_join
from ledgerlens.plans.preparation import prepare_transactions
from ledgerlens.session import scratch_path
from ledgerlens.sources.fixtures import raw_exports, raw_from_driver_tables
from ledgerlens.sources.raw import load_raw
from ledgerlens.sources.sinks import read_transactions, write_transactions


def replaced_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table of the first export, replaced by a job that reads it and adds the second export."""
    path = scratch_path(spark, "transactions")
    first, second = raw_exports(spark, sf_dir)
    write_transactions(prepare_transactions(first), path)
    write_transactions(read_transactions(spark, path).unionByName(prepare_transactions(second)), path)
    return read_transactions(spark, path)


def card_baselines(txn: DataFrame) -> DataFrame:
    """Each card's recent 90th percentiles of hourly count and spend, where it has enough history."""
    found = personal_baseline(hourly_profile(txn))
    return found.select("cc_num", F.col("p90_txns").cast("double").alias("card_p90_txns"), F.col("p90_spend").cast("double").alias("card_p90_spend"))


def large_fraud_pairs(txn: DataFrame) -> DataFrame:
    """Per card all pairs of a legit purchase over $500 and a fraud within 24 hours after it."""
    large = txn.where((F.col("is_fraud") == 0) & (F.col("amt") > 500)).select("cc_num", F.col("trans_ts").alias("legit_ts"), F.col("amt").alias("legit_amt"))
    fraud = txn.where(F.col("is_fraud") == 1).select("cc_num", F.col("trans_ts").alias("fraud_ts"))
    gap = epoch_second("fraud_ts") - epoch_second("legit_ts")
    return (interval_join(large, fraud, "cc_num", "legit_ts", "fraud_ts").groupBy("cc_num")
            .agg(F.count(F.lit(1)).alias("pairs"), F.min(gap).alias("least_seconds"), F.max(gap).alias("most_seconds"), F.sum("legit_amt").cast("double").alias("legit_amt")))


def spoiled_export(raw: DataFrame) -> DataFrame:
    """The raw export as text, with a value made unreadable in every thousandth row of each kind."""
    kind = F.col("trans_num").cast("long") % 1000
    spoil = {"amt": (1, "n/a"), "trans_date_trans_time": (2, "not a time"), "cc_num": (3, "4x"), "is_fraud": (4, "yes"), "dob": (4, "1980-13-45")}
    return raw.select(*[(F.when(kind == spoil[c][0], spoil[c][1]).otherwise(F.col(c).cast("string")) if c in spoil else F.col(c).cast("string")).alias(c) for c in raw.columns])


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw export written as CSV with unreadable values, loaded again: rows and spend that load, and rejects by reason."""
    folder = scratch_path(spark, "export")
    spoiled_export(raw_from_driver_tables(spark, sf_dir)).write.option("header", "true").csv(f"{folder}/raw")
    good = prepare_transactions(load_raw(spark, f"{folder}/raw", f"{folder}/rejects"))
    loaded = good.agg(F.lit("loaded").alias("outcome"), F.count(F.lit(1)).alias("n"), F.sum("amt").cast("double").alias("spend"))
    rejects = spark.read.parquet(f"{folder}/rejects").select(F.explode("reasons").alias("outcome"))
    return loaded.unionByName(rejects.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("spend")))


# columns of the look-up layout, and distinct values that a row group is expected to hold of those with a bloom filter
SKIP_BY = ("merchant", "cc_num", "category")
BLOOM = {"merchant": 10_000, "trans_num": 1_000_000}


def lookup_table(txn: DataFrame, path: str, row_group_bytes: int | None = None, bloom: dict[str, int] | None = None) -> DataFrame:
    """The prepared table written for look-ups by merchant, card, category and transaction number, and read back."""
    write_transactions(txn, path, partition_by=(), cluster_by=("trans_ts", "trans_num"), skip_by=SKIP_BY,
                       bloom=BLOOM if bloom is None else bloom, row_group_bytes=row_group_bytes)
    return read_transactions(txn.sparkSession, path)


def merchant_months(txn: DataFrame, merchant: str) -> DataFrame:
    """One merchant's activity by month."""
    return (txn.where(F.col("merchant") == merchant).groupBy("merchant", "trans_year", "trans_month")
               .agg(F.count(F.lit(1)).alias("txn_count"), F.countDistinct("cc_num").alias("unique_cards"), F.sum("amt").cast("double").alias("spend"),
                    F.sum("is_fraud").cast("long").alias("fraud_count")))


def merchant_lookup(txn: DataFrame) -> DataFrame:
    """The merchant with the largest fraud loss (ties: by name), looked up month by month in a table written for look-ups."""
    base = scratch_path(txn.sparkSession, "lookup")
    # the layout reads its input three times, whole: stored as it comes, an order by month and card would serve none of them
    facts = read_transactions(txn.sparkSession, write_transactions(txn, f"{base}/facts", partition_by=(), cluster_by=()))
    table = lookup_table(facts, f"{base}/table")
    worst = (table.where("is_fraud = 1 AND merchant IS NOT NULL").groupBy("merchant").agg(F.sum("amt").alias("loss"))
                  .orderBy(F.col("loss").desc(), "merchant").first())
    return merchant_months(table, worst.merchant if worst else "")
