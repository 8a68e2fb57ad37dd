"""Declared schemas: the raw card-transaction layout and the prepared table."""

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# Raw export layout (one row per transaction). Only the 19 columns the
# preparation reads are declared; extra columns in a source are ignored.
RAW_SCHEMA = T.StructType([
    T.StructField("trans_date_trans_time", T.StringType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", MONEY),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city_pop", T.LongType()),
    T.StructField("job", T.StringType()),
    T.StructField("dob", T.StringType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
])

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Prepared fact table, one row per transaction, in output order.
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("trans_num", T.StringType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("trans_ts", T.TimestampNTZType()),
    T.StructField("trans_date", T.DateType()),
    T.StructField("trans_year", T.IntegerType()),
    T.StructField("trans_month", T.IntegerType()),
    T.StructField("trans_hour", T.IntegerType()),
    T.StructField("dob", T.DateType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", MONEY),
    T.StructField("customer_name", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city_pop", T.LongType()),
    T.StructField("job", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("dist_km", T.DoubleType()),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS_SCHEMA.fields]
