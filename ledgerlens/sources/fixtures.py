"""Driver tables (TPC-H-like) -> raw card-transaction exports.

One transaction per ``lineitem`` row; an order is one shopping session (same
card, category and hour), so hourly bursts exist. The mapping uses integer
arithmetic only, so any engine reproduces it exactly. It yields two raw tables
("train" and "test", split on order key parity, with different column order)
that the preparation combines by name, as with the original two-file export.

The whole mapping is a join + projection: lineitem joins orders on the order
key (the only big-big join; Spark picks broadcast or shuffle from the sizes), the card's customer,
its nation and the supplier; nothing is collected or broadcast by hand. What one task sorts is
bounded whatever ``spark.sql.shuffle.partitions`` says: the parts of a large lineitem grow in number with its files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.schema import RAW_COLUMNS

# ---------------------------------------------------------------------------
# Fixed values of the mapping.
# ---------------------------------------------------------------------------
CATEGORIES = ("grocery_pos", "shopping_net", "gas_transport", "misc_net", "shopping_pos", "travel")
NIGHT_FRAUD_CATEGORIES = ("shopping_net", "misc_net")
BASE_DATE = "2019-01-01"      # first transaction day
ORDER_EPOCH = "1995-01-01"    # first order date of the driver tables
DAYS_SPAN = 731               # 2019-01-01 .. 2020-12-31
DOB_BASE = "1940-01-01"
TASK_BYTES = 8 << 20          # of lineitem's files to a join task (about half a million rows)
# ---------------------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str, half: int | None = None):
    def t(name, *cols):
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)

    lineitem = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    if half is not None:
        lineitem = lineitem.where(F.pmod(F.col("l_orderkey"), F.lit(2)) == half)
    return (lineitem, t("orders", "o_orderkey", "o_custkey", "o_orderdate"), t("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
            t("nation", "n_nationkey", "n_name"), t("supplier", "s_suppkey", "s_name"))


def _join_tasks(spark: SparkSession, sf_dir: str, half: int | None) -> int:
    """Number of tasks that join with lineitem in parts of ``TASK_BYTES``; 0 where that gives less than one to a core."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    tasks = math.ceil(size / (TASK_BYTES if half is None else 2 * TASK_BYTES))
    return tasks if tasks > spark.sparkContext.defaultParallelism else 0


def _two_digits(x: Column) -> Column:
    return F.lpad(x.cast("int").cast("string"), 2, "0")


def _category(orderkey: Column) -> Column:
    idx = F.pmod(F.pmod(orderkey * 31, F.lit(101)), F.lit(len(CATEGORIES)))
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (idx + 1).cast("int"))


def raw_from_driver_tables(spark: SparkSession, sf_dir: str, half: int | None = None) -> DataFrame:
    """Mapped rows in the raw export layout (strings for time and birth date);
    all rows, or only those whose order key has parity ``half``."""
    lineitem, orders, customer, nation, supplier = _tables(spark, sf_dir, half)
    ok = F.col("o_orderkey")
    card = F.col("o_custkey") - F.pmod(F.col("o_custkey"), F.lit(10))
    tasks = _join_tasks(spark, sf_dir, half)
    if tasks:
        # Orders meet their customers while they are few and narrow; lineitem moves once, in parts of bounded size. The parts of a
        # supplier table too large for a broadcast are as many, so the rows that meet it are cut alike.
        sessions = orders.withColumn("card", card).join(customer, F.col("c_custkey") == F.col("card")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        base = (lineitem.repartition(tasks, "l_orderkey").join(sessions, F.col("l_orderkey") == ok)
                .join(supplier.repartition(tasks, "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    else:
        # The shuffle by order key that a join with a large orders table needs anyway (it is reused there, not added); where orders
        # is small enough for a broadcast, it spreads a table of few row groups over all cores before the wide projection.
        base = (lineitem.hint("rebalance", "l_orderkey").join(orders, F.col("l_orderkey") == ok)
                .withColumn("card", card)
                .join(customer, F.col("c_custkey") == F.col("card"))
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))

    trans_date = F.date_add(F.lit(BASE_DATE).cast("date"),
                            F.pmod(F.datediff(F.col("o_orderdate").cast("date"),
                                              F.lit(ORDER_EPOCH).cast("date")), F.lit(DAYS_SPAN)).cast("int"))
    hour = F.pmod(ok * 37, F.lit(24))
    sec_of_hour = F.pmod(F.col("l_partkey") * 61 + F.col("l_linenumber") * 577, F.lit(3600))
    ts_text = F.concat(F.date_format(trans_date, "yyyy-MM-dd"), F.lit(" "), _two_digits(hour), F.lit(":"),
                       _two_digits(F.floor(sec_of_hour / 60)), F.lit(":"),
                       _two_digits(F.pmod(sec_of_hour, F.lit(60))))
    category = _category(ok)
    key = F.col("c_custkey")
    lat_centi = 2500 + F.pmod(key * 31, F.lit(2400))
    long_centi = -12000 + F.pmod(key * 53, F.lit(4500))
    night_fraud = (hour >= 22) & category.isin(*NIGHT_FRAUD_CATEGORIES) & (F.pmod(ok, F.lit(5)) < 2)
    sporadic_fraud = F.pmod(F.col("l_orderkey") * 13 + F.col("l_partkey"), F.lit(400)) == 0
    name_parts = F.split(F.col("c_name"), "#")

    return base.select(
        ts_text.alias("trans_date_trans_time"),
        F.col("card").cast("long").alias("cc_num"),
        F.col("s_name").alias("merchant"),
        category.alias("category"),
        (F.floor("l_extendedprice").cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)"))
        .cast("decimal(12,2)").alias("amt"),
        name_parts.getItem(0).alias("first"),
        name_parts.getItem(1).alias("last"),
        F.when(F.pmod((key - F.pmod(key, F.lit(10))) / 10, F.lit(2)) < 1, "F").otherwise("M").alias("gender"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("state"),
        (F.pmod(key * 104729, F.lit(997)) * F.pmod(key * 104729, F.lit(997))).cast("long").alias("city_pop"),
        F.col("c_mktsegment").alias("job"),
        F.date_format(F.date_add(F.lit(DOB_BASE).cast("date"),
                                 F.pmod(key * 7919, F.lit(23000)).cast("int")), "yyyy-MM-dd").alias("dob"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("trans_num"),
        (lat_centi.cast("double") / 100.0).alias("lat"),
        (long_centi.cast("double") / 100.0).alias("long"),
        ((lat_centi + F.pmod(F.col("l_suppkey") * 17, F.lit(200)) - 100).cast("double") / 100.0).alias("merch_lat"),
        ((long_centi + F.pmod(F.col("l_suppkey") * 29, F.lit(200)) - 100).cast("double") / 100.0).alias("merch_long"),
        F.when(night_fraud | sporadic_fraud, 1).otherwise(0).cast("int").alias("is_fraud"),
    )


def raw_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mapped rows as two raw exports ("train", "test") with different column order. Each reads its half of
    lineitem; a report over all rows reads them in one pass through :func:`raw_from_driver_tables`."""
    return (raw_from_driver_tables(spark, sf_dir, half=0).select(*RAW_COLUMNS),
            raw_from_driver_tables(spark, sf_dir, half=1).select(*reversed(RAW_COLUMNS)))
