"""Summarise the executed (post-AQE) physical plans of every report.

Usage: python tools/plan_report.py [sf_dir] [name ...]
Per report: scans and their pushed filters / read schema, shuffle exchanges,
broadcasts, sorts, windows, single-partition exchanges, Python evaluation. Plans of
the jobs that run while a report is built (rankings) come from Spark's event log and
are listed first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile

sys.path.insert(0, ".")

from ledgerlens.plans.catalog import REPORTS, transactions_from_driver_tables  # noqa: E402
from ledgerlens.session import local_session, scratch_path  # noqa: E402
from ledgerlens.sources.sinks import read_transactions, write_transactions  # noqa: E402


def summary(lines: list[str]) -> str:
    count = lambda pat: sum(1 for ln in lines if re.search(pat, ln))
    return (f"parquet scans={count('FileScan|Scan parquet')} "
            f"shuffles={count('Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)')} single-partition={count('SinglePartition')} "
            f"broadcasts={count('BroadcastExchange')} reused={count('Reused')} sorts={count(' Sort |^Sort ')} "
            f"windows={count('Window ')} python={count('EvalPython|PythonUDF')} "
            f"sort-merge joins={count('SortMergeJoin')} broadcast joins={count('BroadcastHashJoin')}")


def _nodes(node: dict) -> list[str]:
    return [node["simpleString"], *(x for child in node["children"] for x in _nodes(child))]


def executions(spark, log_dir: str) -> list[list[str]]:
    """Plan nodes of every SQL execution so far, as they finally ran, in order."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans: dict[int, list[str]] = {}
    for name in os.listdir(log_dir):
        for line in open(os.path.join(log_dir, name), errors="replace"):
            event = json.loads(line) if line.endswith("}\n") else {}
            if "sparkPlanInfo" in event:
                plans[event["executionId"]] = _nodes(event["sparkPlanInfo"])
    return [plans[k] for k in sorted(plans)]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="ledgerlens-events-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log_dir} --conf spark.eventLog.compress=false "
                                         "--conf spark.eventLog.rolling.enabled=false pyspark-shell")
    spark = local_session(8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # do not truncate pushed filters
    path = scratch_path(spark, "plan-report")
    write_transactions(transactions_from_driver_tables(spark, sf_dir), path)
    txn = read_transactions(spark, path)
    for name, fn in REPORTS.items():
        if only and name not in only:
            continue
        before = len(executions(spark, log_dir))
        df = fn(txn)
        built = executions(spark, log_dir)[before:]
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        print(f"\n### {name}\n")
        for nodes in built:
            print(f"- job while building: {summary(nodes)}")
        print(f"- {summary(lines)}")
        for ln in lines:
            if "FileScan" in ln:
                pf = re.search(r"PushedFilters: \[([^\]]*)\]", ln)
                rs = re.search(r"ReadSchema: (struct<[^>]*>)", ln)
                print(f"- scan: pushed `[{pf.group(1) if pf else ''}]`, schema `{rs.group(1) if rs else ''}`")
            if "SinglePartition" in ln or "Window [" in ln:
                print("- `" + ln.strip().lstrip("+-: ")[:150] + "`")


if __name__ == "__main__":
    main()
