"""Raw export readers (CSV with header, Parquet) and the prepared-table sink."""

import datetime as dt
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from txn_rows import SF_SMALL
from ledgerlens.plans.catalog import transactions_from_driver_tables
from ledgerlens.plans.preparation import prepare_transactions
from ledgerlens.schema import RAW_COLUMNS, TRANSACTION_COLUMNS
from ledgerlens.sources import load_raw, read_raw, read_raw_checked, read_transactions, write_transactions
from ledgerlens.sources.versions import replace, resolve

HEADER = ["", "trans_date_trans_time", "cc_num", "merchant", "category", "amt", "first", "last", "gender",
          "street", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob", "trans_num", "unix_time",
          "merch_lat", "merch_long", "is_fraud"]


def test_read_raw_csv_with_extra_columns(spark):
    d = tempfile.mkdtemp(prefix="ledgerlens-csv-")
    rows = [
        ["0", "2019-01-01 00:00:18", "4000123412341234", "m_alpha", "misc_net", "4.97", "Ann", "Lee",
         "F", "1 Main St", "Springfield", "NC", "28600", "36.0", "-81.0", "3495", "Teacher",
         "1988-03-09", "t0001", "1325376018", "36.1", "-81.1", "0"],
        ["1", "2019-01-01 00:00:44", "4000999988887777", "m_beta", "grocery_pos", "107.23", "Bo", "Kim",
         "M", "2 Oak Ave", "Riverton", "WA", "99100", "48.0", "-118.0", "149", "Nurse",
         "1978-06-21", "t0002", "1325376044", "48.2", "-118.1", "1"],
    ]
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write(",".join(HEADER) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
    raw = read_raw(spark, d, "csv")
    assert raw.columns == RAW_COLUMNS
    txn = prepare_transactions(raw).orderBy("trans_ts").collect()
    assert txn[0].cc_num == 4000123412341234 and str(txn[0].amt) == "4.97"
    assert txn[0].trans_ts == dt.datetime(2019, 1, 1, 0, 0, 18) and txn[0].customer_name == "Ann Lee"
    assert txn[1].is_fraud == 1 and txn[1].age == 42 and 20 < txn[1].dist_km < 40


def test_sink_round_trip_partitioned(spark, tmp_path):
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    path = str(tmp_path / "t")
    write_transactions(txn, path)
    back = read_transactions(spark, path)
    assert back.columns == TRANSACTION_COLUMNS
    assert back.count() == txn.count()
    assert any(name.startswith("trans_year=") for name in os.listdir(resolve(spark, path)))
    # partition pruning on year/month reaches the file listing
    plan = back.where((F.col("trans_year") == 2020) & (F.col("trans_month") == 12))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trans_year" in plan
    assert back.exceptAll(txn.select(*TRANSACTION_COLUMNS)).count() == 0


def test_read_raw_parquet(spark, tmp_path):
    from ledgerlens.sources.fixtures import raw_from_driver_tables
    path = str(tmp_path / "raw")
    raw_from_driver_tables(spark, SF_SMALL).write.parquet(path)
    assert read_raw(spark, path, "parquet").columns == RAW_COLUMNS


def test_sql_view_over_prepared_table(spark):
    from ledgerlens.plans.catalog import register_transactions_view
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    register_transactions_view(txn)
    n = spark.sql("SELECT count(*) FROM transactions WHERE is_fraud = 1").first()[0]
    assert n == txn.where("is_fraud = 1").count() > 0


def test_exports_belong_to_the_session_that_asked(spark):
    from ledgerlens.sources.fixtures import raw_exports
    other = spark.newSession()
    a = raw_exports(spark, SF_SMALL)[0]
    b = raw_exports(other, SF_SMALL)[0]
    assert a.sparkSession is spark and b.sparkSession is other


def test_sink_plan_rebalances_by_month_and_sorts_locally(spark):
    from ledgerlens.sources.sinks import layout_for_write
    df = layout_for_write(transactions_from_driver_tables(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert "Sort [trans_year" in plan and ", false, 0" in plan  # local (non-global) sort


def _versions(path):
    return sorted(n for n in os.listdir(path) if n.startswith("version-"))


def test_a_killed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    write_transactions(txn.where("is_fraud = 1"), path)
    old, frauds = resolve(spark, path), read_transactions(spark, path).count()

    # fails while rows are written
    with pytest.raises(Exception, match="stop here"):
        write_transactions(txn.withColumn("city", F.when(F.col("trans_hour") == 3, F.raise_error(F.lit("stop here"))).otherwise(F.col("city"))), path)
    assert resolve(spark, path) == old and read_transactions(spark, path).count() == frauds

    # killed after the folder was written, before the pointer was switched
    def dies(folder):
        txn.write.parquet(folder)
        raise KeyboardInterrupt
    with pytest.raises(KeyboardInterrupt):
        replace(spark, path, dies)
    assert resolve(spark, path) == old and read_transactions(spark, path).count() == frauds
    # the next write takes the leftovers away and keeps the version before
    write_transactions(txn, path)
    assert read_transactions(spark, path).count() == txn.count()
    assert len(_versions(path)) == 2 and os.path.basename(old) in _versions(path)


def test_a_table_is_read_and_replaced_by_one_job_while_others_read(spark, tmp_path):
    path = str(tmp_path / "t")
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    write_transactions(txn.where("trans_hour < 12"), path)
    reader = read_transactions(spark, path)
    n = reader.count()
    write_transactions(reader.unionByName(txn.where("trans_hour >= 12").select(*TRANSACTION_COLUMNS)), path)
    # a reader that began before goes on with its version
    assert reader.count() == n and read_transactions(spark, path).count() == txn.count()
    for _ in range(3):
        write_transactions(read_transactions(spark, path).where("is_fraud = 1"), path, keep=1)
    assert len(_versions(path)) == 1 and read_transactions(spark, path).count() == txn.where("is_fraud = 1").count()
    assert sorted(n for n in os.listdir(path) if not n.startswith((".", "version-"))) == ["_current"]


def test_a_plain_folder_is_read_as_it_is(spark, tmp_path):
    path = str(tmp_path / "t")
    transactions_from_driver_tables(spark, SF_SMALL).write.parquet(path)
    assert resolve(spark, path) == path and read_transactions(spark, path).count() > 0


LINE = ["0", "2019-01-01 00:00:18", "4000123412341234", "m_alpha", "misc_net", "4.97", "Ann", "Lee", "F", "1 Main St", "Springfield", "NC", "28600", "36.0", "-81.0",
        "3495", "Teacher", "1988-03-09", "t0001", "1325376018", "36.1", "-81.1", "0"]


def _line(**change):
    return ",".join(change.get(c, v) for c, v in zip(HEADER, LINE))


def test_rejects_channel(spark, tmp_path):
    lines = [",".join(HEADER), _line(trans_num="ok1"), _line(amt="4,97"), _line(amt="abc", cc_num="4x"), _line(trans_date_trans_time="yesterday"), _line(dob="1988-02-30"),
             _line(trans_num="ok2", amt=""), "1,2,3", _line(is_fraud="99999999999"), _line(amt="12345678901.00"), _line(trans_num="ok3", merch_lat="1e1")]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    good, rejects = read_raw_checked(spark, str(tmp_path / "raw.csv"))
    assert good.columns == RAW_COLUMNS and sorted(r.trans_num for r in good.collect()) == ["ok1", "ok2", "ok3"]
    got = rejects.collect()
    assert sorted(tuple(r.reasons) for r in got) == sorted([("malformed row",), ("bad cc_num", "bad amt"), ("bad trans_date_trans_time",), ("bad dob",), ("malformed row",), ("bad is_fraud",), ("bad amt",)])
    assert {r.record for r in got if r.reasons == ["malformed row"]} == {lines[2], "1,2,3"} and all(r.file.endswith("raw.csv") for r in got)
    # nothing fails later on
    assert prepare_transactions(good).count() == 3


def test_good_rows_equal_the_strict_load(spark, tmp_path):
    from ledgerlens.plans.operations import spoiled_export
    from ledgerlens.sources.fixtures import raw_from_driver_tables
    raw = raw_from_driver_tables(spark, SF_SMALL)
    raw.write.option("header", "true").csv(str(tmp_path / "clean"))
    spoiled_export(raw).write.option("header", "true").csv(str(tmp_path / "spoiled"))
    strict = read_raw(spark, str(tmp_path / "clean"))
    assert load_raw(spark, str(tmp_path / "clean"), str(tmp_path / "none")).exceptAll(strict).isEmpty() and spark.read.parquet(str(tmp_path / "none")).isEmpty()
    good = load_raw(spark, str(tmp_path / "spoiled"), str(tmp_path / "rejects"))
    clean = strict.where("cast(trans_num as long) % 1000 NOT BETWEEN 1 AND 4")
    assert good.exceptAll(clean).isEmpty() and clean.exceptAll(good).isEmpty()
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == strict.count() - clean.count() > 0
    # Parquet exports of strings go the same way
    spoiled_export(raw).write.parquet(str(tmp_path / "pq"))
    assert read_raw_checked(spark, str(tmp_path / "pq"), "parquet")[0].count() == clean.count()


def test_mapping_shuffles_lineitem_once_whatever_the_join(spark):
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = transactions_from_driver_tables(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "SortMergeJoin [l_orderkey" in plan
    assert txn._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(l_orderkey") == 1


def test_mapping_cuts_a_large_lineitem_into_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """Twice the rows give twice the join tasks whatever the session's number of shuffle partitions, and the same rows as one small table."""
    from ledgerlens.sources import fixtures

    def tables(folder, n):
        ship = "timestamp_ntz'2000-03-01 00:00:00'"
        # keys repeat and may be null on both sides
        columns = {
            "lineitem": (n, "nullif(id % 500, 7) AS l_orderkey", "id AS l_partkey", "nullif(id % 9, 8) AS l_suppkey", "cast(id % 3 AS int) AS l_linenumber", "id * 1.5D AS l_extendedprice"),
            "orders": (520, "nullif(id % 510, 9) AS o_orderkey", "nullif(id % 60, 11) AS o_custkey", f"if(id % 50 = 0, null, {ship}) AS o_orderdate"),
            "customer": (62, "id % 60 AS c_custkey", "concat('C#', id) AS c_name", "cast(id % 4 AS int) AS c_nationkey", "nullif('m', if(id = 10, 'm', '')) AS c_mktsegment"),
            "nation": (4, "cast(id AS int) AS n_nationkey", "concat('n', id) AS n_name"),
            "supplier": (10, "id % 9 AS s_suppkey", "concat('s', id) AS s_name")}
        for name, (rows, *made) in columns.items():
            spark.range(0, rows, 1, 1).selectExpr(*made).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    def cut(folder):
        plan = fixtures.raw_from_driver_tables(spark, folder)._jdf.queryExecution().executedPlan().toString()
        return [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]

    small, large = tables(tmp_path / "small", 20_000), tables(tmp_path / "large", 40_000)
    want = {f: fixtures.raw_from_driver_tables(spark, f).cache() for f in (small, large)}
    assert all(df.count() > 0 for df in want.values()) and cut(small) == []
    monkeypatch.setattr(fixtures, "TASK_BYTES", 1 << 13)
    (few,), (many,) = cut(small), cut(large)
    assert few > 8 and 1.7 * few < many < 2.3 * few
    for folder, df in want.items():
        for threshold in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            try:
                got = fixtures.raw_from_driver_tables(spark, folder)
                assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
                halves = fixtures.raw_exports(spark, folder)
                assert halves[0].unionByName(halves[1]).count() == df.count()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        df.unpersist()
