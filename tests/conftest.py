from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from tiffin.sources import SCHEMAS, Tables  # noqa: E402
from tiffin.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=8, app_name="tiffin-tests")
    yield session
    session.stop()


def T(h: int, m: int = 0, s: int = 0) -> int:
    """Seconds of the day for hh:mm:ss."""
    return h * 3600 + m * 60 + s


D = dt.date


@pytest.fixture()
def make_tables(spark):
    """Build Tables from small row lists (missing tables are empty)."""

    def build(**rows) -> Tables:
        frames = {}
        for name, schema in SCHEMAS.items():
            frames[name] = spark.createDataFrame(rows.get(name, []), schema=schema)
        return Tables(**frames)

    return build


def collect(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
