"""Driver contract: entry, query registry, DuckDB oracle agreement, plan shape."""

import hashlib
import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from txn_rows import SF_SMALL
from ledgerlens.oracle import oracle_sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_DUCK_TYPE = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rules_triggered" in df.columns


def test_every_query_has_an_oracle():
    own = {n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own == set(oracle_sql()) and own <= set(E.oracle_sql())
    assert len(own) == 42


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    assert {f.name: _DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in sdf.schema.fields} == duck_types
    assert len(srows) == len(orows)
    assert _digest(srows, sdf.columns) == _digest(orows, ocols)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_filters_pushed_and_columns_pruned(spark, tmp_path):
    from ledgerlens.plans.catalog import transactions_from_driver_tables
    from ledgerlens.plans.segmentation import age_band_spend
    from ledgerlens.sources.sinks import read_transactions, write_transactions
    path = str(tmp_path / "txn")
    write_transactions(transactions_from_driver_tables(spark, SF_SMALL), path)
    txn = read_transactions(spark, path)
    df = age_band_spend(txn)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_fraud,0)" in text
    scan = [line for line in text.splitlines() if "FileScan parquet" in line][0]
    for col in ("age", "gender", "cc_num", "amt", "is_fraud"):
        assert col in scan
    for col in ("merchant", "dist_km", "customer_name"):
        assert col not in scan.split("ReadSchema")[-1]


def test_top_k_is_take_ordered(spark):
    from ledgerlens.plans.catalog import transactions_from_driver_tables
    from ledgerlens.plans.category import top_merchants
    df = top_merchants(transactions_from_driver_tables(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in _plan(df)


@pytest.mark.parametrize("name", ["rfm_segments", "segment_fraud_exposure", "rolling_spend_decline", "fraud_after_large"])
def test_rankings_match_with_many_partitions(spark, duck, name):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sdf = E.queries()[name](spark, SF_SMALL)
        rows = [tuple(r) for r in sdf.collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    res = duck.execute(E.oracle_sql()[name])
    assert _digest(rows, sdf.columns) == _digest(res.fetchall(), [d[0] for d in res.description])


def test_reports_scan_lineitem_once(spark):
    from ledgerlens.plans.catalog import REPORTS, transactions_from_driver_tables
    txn = transactions_from_driver_tables(spark, SF_SMALL)
    plan = REPORTS["category_scorecard"](txn)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert "RoundRobin" not in plan
    # the hourly table and the context rates
    plan = REPORTS["layered_alerts"](txn)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2


def test_files_added_to_a_table_are_seen(spark, tmp_path):
    import shutil
    from ledgerlens.plans.catalog import transactions_from_driver_tables
    for t in TABLES:
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet/a.parquet")
    first = transactions_from_driver_tables(spark, str(tmp_path)).count()
    shutil.copy(f"{SF_SMALL}/lineitem.parquet", tmp_path / "lineitem.parquet/b.parquet")
    assert transactions_from_driver_tables(spark, str(tmp_path)).count() == 2 * first > 0
