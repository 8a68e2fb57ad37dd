"""Test data of the core suite: the driver's small tables and hand-made prepared rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerlens.schema import TRANSACTIONS_SCHEMA

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

_DEFAULTS = {
    "trans_num": "t", "cc_num": 1, "trans_ts": dt.datetime(2020, 1, 1, 12, 0, 0), "trans_date": None,
    "trans_year": None, "trans_month": None, "trans_hour": None, "dob": dt.date(1980, 1, 1), "age": 40,
    "merchant": "m1", "category": "grocery_pos", "amt": Decimal("10.00"), "customer_name": "A B",
    "gender": "F", "city": "c", "state": "S1", "city_pop": 1000, "job": "j", "lat": 40.0, "long": -75.0,
    "merch_lat": 40.0, "merch_long": -75.0, "is_fraud": 0, "dist_km": 0.0,
}


def make_txn(spark, rows):
    """Prepared-table rows from partial dicts; calendar fields follow ``trans_ts``."""
    out = []
    for r in rows:
        d = {**_DEFAULTS, **r}
        ts = d["trans_ts"]
        if isinstance(d["amt"], (int, float, str)):
            d["amt"] = Decimal(str(d["amt"])).quantize(Decimal("0.01"))
        d["trans_date"] = d["trans_date"] or ts.date()
        d["trans_year"] = d["trans_year"] or ts.year
        d["trans_month"] = d["trans_month"] or ts.month
        d["trans_hour"] = d["trans_hour"] if d["trans_hour"] is not None else ts.hour
        out.append(tuple(d[f.name] for f in TRANSACTIONS_SCHEMA.fields))
    return spark.createDataFrame(out, TRANSACTIONS_SCHEMA)
