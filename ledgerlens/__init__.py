"""ledgerlens: card-transaction customer and fraud-risk analytics on Spark.

Layers
------
``sources``    raw readers with declared schemas, the driver-table mapping, sinks
``functions``  Column-level rules (distance, age, bands, exact ratios, RFM rules)
``operators``  DataFrame-level building blocks (label rates, scalable NTILE/RANK,
               period series, RFM scoring, layered alerts, interval join)
``plans``      the 21 data products as thin compositions of the operators
``streaming``  incremental (Structured Streaming) form of the hourly alert rules
"""

from ledgerlens.plans.catalog import REPORTS, run_report  # noqa: F401

__all__ = ["REPORTS", "run_report"]
