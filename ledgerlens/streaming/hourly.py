"""Layer-1 velocity rules as a Structured Streaming job.

Raw export files land in a folder; each micro-batch is prepared with the same
projection as the batch table (stateless), then aggregated per card x
category x hour in a 1-hour tumbling event-time window. A watermark bounds the
state: once it passes a window's end the hour is final, the absolute rules are
applied and only flagged hours are emitted (append mode), so every closed hour
is reported once with the same numbers the batch ``hourly_profile`` gives.

Differences from the batch path, by necessity of streaming:
* rows arriving after the watermark has passed their hour are dropped;
* streaming aggregation refuses ``countDistinct``, so each hour is first aggregated per merchant and those
  rows are then counted: two chained keyed aggregations, so a busy card-hour's state is spread over merchants.
* the event-time column is the wall-clock ``trans_ts`` read as UTC, so window
  boundaries equal the wall-clock hours whatever the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions import epoch_second, flag_sum
from ledgerlens.operators.alerts import ONLINE_PATTERN, absolute_rules
from ledgerlens.plans.preparation import prepare_transactions
from ledgerlens.schema import RAW_COLUMNS, RAW_SCHEMA


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                    csv_columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A stream of raw export files.

    Parquet is read with the declared schema (columns resolved by name). A
    streaming CSV reader maps a given schema by *position*, so CSV files are
    read as text in their header order (``csv_columns``, default: the declared
    layout) and the preparation casts the needed columns by name, exactly as
    the batch reader does.
    """
    if fmt == "csv":
        text_schema = T.StructType([T.StructField(c, T.StringType()) for c in (csv_columns or RAW_COLUMNS)])
        reader = spark.readStream.schema(text_schema).format("csv").option("header", "true")
    else:
        reader = spark.readStream.schema(RAW_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.options(**options).load(path)


def hourly_profile_stream(prepared: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Per card x date x category x hour activity over a 1-hour event-time window."""
    keyed = prepared.where(F.col("cc_num").isNotNull() & F.col("category").isNotNull()
                           & F.col("trans_ts").isNotNull())
    events = keyed.withColumn("_event_time", F.timestamp_seconds(epoch_second("trans_ts")))
    keys = ["cc_num", "trans_date", "category", "txn_hour"]
    per_merchant = (events.withWatermark("_event_time", watermark)
                          .groupBy(F.window("_event_time", "1 hour").alias("hour"), "cc_num", "trans_date", "category",
                                   F.col("trans_hour").alias("txn_hour"), "merchant")
                          .agg(F.count(F.lit(1)).alias("_n"), F.sum("amt").alias("_amt"), F.sum("is_fraud").alias("_fraud"),
                               flag_sum(~F.col("category").like(ONLINE_PATTERN)).alias("_inperson")))
    # the hour's own time places the merchant rows in the same window again
    return (per_merchant.groupBy(F.window(F.window_time("hour"), "1 hour").alias("window"), *keys)
                        .agg(F.sum("_n").alias("txns_in_hour"),
                             F.round(F.sum("_amt"), 2).alias("spend_in_hour"),
                             F.sum("_fraud").cast("long").alias("fraud_in_hour"),
                             F.count("merchant").alias("distinct_merchants"),
                             F.sum("_inperson").cast("long").alias("inperson_txns")))


def hourly_alert_stream(raw_stream: DataFrame, watermark: str = "2 hours", **rule_params) -> DataFrame:
    """Flagged card-category-hours (layer 1) from a raw export stream."""
    hourly = hourly_profile_stream(prepare_transactions(raw_stream), watermark)
    return (absolute_rules(hourly, **rule_params)
            .where(F.col("rules_triggered") > 0)
            .withColumn("window_end", F.col("window.end"))
            .drop("window"))


def start_hourly_alerts(spark: SparkSession, source_path: str, sink_path: str, checkpoint_location: str,
                        name: str = "hourly_alerts", fmt: str = "parquet", watermark: str = "2 hours",
                        available_now: bool = False, processing_time: str = "1 minute",
                        csv_columns: Sequence[str] | None = None) -> StreamingQuery:
    """Run the stream into a Parquet sink.

    ``checkpoint_location`` holds progress and state: a fixed folder of this job's own on storage that the
    driver and all executors share. A later application given the same folder and sink goes on where the last one
    stopped, each closed hour once.
    """
    writer = (hourly_alert_stream(read_raw_stream(spark, source_path, fmt, csv_columns=csv_columns), watermark)
              .writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_location).option("path", sink_path).queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
