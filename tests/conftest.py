from __future__ import annotations

import os
import sys

import pytest

# the library, and the modules of test data beside this file
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="ledgerlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def own_cache():
    """What a module caches goes with it: Spark would put it into the plans of later modules that read the same tables."""
    yield
    from pyspark.sql import SparkSession
    if session := SparkSession.getActiveSession():
        session.catalog.clearCache()
