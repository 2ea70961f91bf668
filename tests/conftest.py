"""Shared Spark session and hand-made fixtures (FIXTURES.md F1, F5)."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulyst.session import checkpoint_dir, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tabulyst-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def shop(spark):
    """25 daily rows; sales distinct, spend = sales/2 except one day, traffic = 10 x spend."""
    rows = []
    for i in range(25):
        sales = 1000 + 37 * i + (i * i) % 11
        spend = sales // 2 if i != 3 else 450
        traffic = spend * 10
        rows.append(((dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), sales, spend, traffic,
                     traffic // 100, 0.01))
    return spark.createDataFrame(rows, "date string, sales int, marketing_spend int, traffic int, customers int, "
                                       "conversion_rate double")


@pytest.fixture(scope="session")
def dirty(spark):
    """F5 dirty: padded text, null and NaN, equal rows, tied modes, one extreme x."""
    nan = math.nan
    rows = [
        (1, "  alice ", "a", 1.0, 10), (2, "bob\t", "b", 2.0, 20), (3, "carol", "a", None, 30),
        (4, None, "b", 4.0, None), (5, "dave", None, nan, 50), (6, "erin", "c", 6.0, 60),
        (6, "erin", "c", 6.0, 60), (7, "frank", "a", 7.0, 70), (8, "gina", "b", 1000.0, 80),
        (9, "  alice ", "a", 1.0, 10), (10, "hank", "c", 3.0, 40), (11, "ivy", "b", 5.0, 55),
    ]
    return spark.createDataFrame(rows, "id long, name string, grp string, x double, y int")
