"""Command line: prepare from raw export files, then run reports into a sink."""

import os

from txn_rows import SF_SMALL
from ledgerlens.__main__ import main
from ledgerlens.sources.fixtures import raw_exports


def test_prepare_then_report(spark, tmp_path):
    train, test = raw_exports(spark, SF_SMALL)
    train.write.parquet(str(tmp_path / "train"))
    test.write.parquet(str(tmp_path / "test"))
    table = str(tmp_path / "transactions")
    assert main(["prepare", str(tmp_path / "train"), str(tmp_path / "test"), "--out", table,
                 "--format", "parquet"]) == 0
    out = str(tmp_path / "reports")
    assert main(["report", "category_scorecard", "elevated_states", "--table", table, "--out", out]) == 0
    assert sorted(os.listdir(out)) == ["category_scorecard", "elevated_states"]
    assert spark.read.parquet(f"{out}/category_scorecard").count() == 6


def test_show_prints_every_row_or_the_limit(spark, tmp_path, capsys):
    from ledgerlens.plans.catalog import transactions_from_driver_tables
    from ledgerlens.sources import write_transactions
    table = str(tmp_path / "transactions")
    write_transactions(transactions_from_driver_tables(spark, SF_SMALL), table)
    assert main(["report", "hour_category_pattern", "--table", table]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0] == "== hour_category_pattern" and lines[1].startswith("trans_hour,category,") and len(lines) > 2 + 50
    assert main(["report", "hour_category_pattern", "--table", table, "--limit", "3"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 5
