"""The query catalogue: every job under a stable key, with its parameters.

``CATALOG`` holds the jobs with the worksheet's literals, which are the
defaults of the command line.  ``TEST_PARAMS`` holds what the registered queries use
instead on the generated test data (whose dates end 2001-08-01 and whose
names are ``Customer#...``); :func:`test_job` joins the two.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tiffin.plans import checks, questions
from tiffin.sources import from_tpch

Job = Callable[..., DataFrame]

TEST_AS_OF = dt.date(2001, 8, 1)
TEST_CUSTOMER = "Customer#000000005"

_Q1 = dict(customer_name=questions.DEFAULT_CUSTOMER, as_of=None, years=1, k=questions.DEFAULT_TOP_K)
_Q6 = dict(as_of=None, years=1, keep_rank=1)

# key -> (job, default parameters)
CATALOG: dict[str, tuple[Job, dict]] = {
    "scan_customers": (partial(checks.scan, table="customers"), {}),
    "scan_restaurants": (partial(checks.scan, table="restaurants"), {}),
    "scan_orders": (partial(checks.scan, table="orders"), {}),
    "scan_riders": (partial(checks.scan, table="riders"), {}),
    "scan_deliveries": (partial(checks.scan, table="deliveries"), {}),
    "null_count_customers": (checks.null_count_customers, {}),
    "null_count_restaurants": (checks.null_count_restaurants, {}),
    "null_rows_orders": (checks.null_rows_orders, {}),
    "drop_null_orders": (checks.drop_null_orders, {}),
    "pk_audit": (checks.pk_audit, {}),
    "fk_audit": (checks.fk_audit, {}),
    "length_audit": (checks.varchar_audit, {}),
    "q01_top_dishes": (questions.q01_top_dishes, _Q1),
    "q01_top_dishes_3y": (questions.q01_top_dishes, _Q1 | dict(years=3)),
    "q01_top_dishes_7y": (questions.q01_top_dishes, _Q1 | dict(years=7, k=1)),
    "q01_top_dishes_today": (questions.q01_top_dishes, _Q1 | dict(years=30)),
    "q02_time_slots": (questions.q02_time_slots, dict(hours=2)),
    "q03_avg_order_value": (questions.q03_avg_order_value, dict(min_orders=questions.DEFAULT_MIN_ORDERS)),
    "q04_high_spenders": (questions.q04_high_spenders, dict(min_total=questions.DEFAULT_MIN_TOTAL)),
    "q05_undelivered": (questions.q05_undelivered, {}),
    "q06_top_restaurant_by_city": (questions.q06_top_restaurant_by_city, _Q6),
    "q06_full_ranking": (questions.q06_top_restaurant_by_city, _Q6 | dict(keep_rank=None)),
    "q06_full_ranking_today": (questions.q06_top_restaurant_by_city, dict(as_of=None, years=30, keep_rank=None)),
    "q07_top_dish_by_city": (questions.q07_top_dish_by_city, dict(keep_rank=1)),
    "q07_full_ranking": (questions.q07_top_dish_by_city, dict(keep_rank=None)),
    "q08_lapsed_customers": (questions.q08_lapsed_customers, dict(active_year=2023, absent_year=2024)),
    "q08_lapsed_customers_not_in": (
        questions.q08_lapsed_customers_not_in,
        dict(active_year=2023, absent_year=2024),
    ),
    "q09_cancellation_rate": (
        questions.q09_cancellation_rate,
        dict(previous_year=2023, current_year=2024),
    ),
    "q10_delivery_minutes": (questions.q10_delivery_minutes, dict(status=questions.DELIVERED)),
    "q11_monthly_growth": (questions.q11_monthly_growth, dict(status=questions.DELIVERED)),
    "q12_segments": (questions.q12_segments, dict(multiple=1)),
    "q12_segments_10x": (questions.q12_segments, dict(multiple=10)),
    "q13_rider_earnings": (questions.q13_rider_earnings, dict(share=questions.DEFAULT_RIDER_SHARE)),
}

_TEST_Q1 = dict(customer_name=TEST_CUSTOMER, as_of=TEST_AS_OF)
_TEST_Q8 = dict(active_year=2000, absent_year=2001)
#: What differs on the test data.  The ``today`` keys keep the current date.
TEST_PARAMS: dict[str, dict] = {
    "q01_top_dishes": _TEST_Q1,
    "q01_top_dishes_3y": _TEST_Q1,
    "q01_top_dishes_7y": _TEST_Q1,
    "q01_top_dishes_today": dict(customer_name=TEST_CUSTOMER),
    "q03_avg_order_value": dict(min_orders=15),
    "q04_high_spenders": dict(min_total=4_000_000),
    "q06_top_restaurant_by_city": dict(as_of=TEST_AS_OF),
    "q06_full_ranking": dict(as_of=TEST_AS_OF),
    "q08_lapsed_customers": _TEST_Q8,
    "q08_lapsed_customers_not_in": _TEST_Q8,
    "q09_cancellation_rate": dict(previous_year=2000, current_year=2001),
}


def _date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _or_none(parse: Callable[[str], object]) -> Callable[[str], object]:
    return lambda text: None if text == "None" else parse(text)


#: How the text of each parameter is read.
PARAM_TYPES: dict[str, Callable[[str], object]] = {
    "customer_name": str,
    "status": str,
    "share": str,
    "as_of": _or_none(_date),
    "keep_rank": _or_none(int),
    "min_total": float,
    "multiple": float,
    "cols": lambda text: text.split(","),
    "as_interval": lambda text: {"true": True, "false": False}[text.lower()],
} | {
    name: int
    for name in (
        "years", "k", "hours", "min_orders", "active_year", "absent_year", "previous_year", "current_year",
        "lookup_rows", "target_max_rows",
    )
}


def parse_params(texts: dict[str, str]) -> dict[str, object]:
    """Parameters from text, each by its own type."""
    unknown = sorted(set(texts) - set(PARAM_TYPES))
    if unknown:
        raise ValueError(f"unknown parameters {unknown}; known are {sorted(PARAM_TYPES)}")
    return {name: PARAM_TYPES[name](text) for name, text in texts.items()}


def test_job(key: str) -> tuple[Job, dict]:
    """The job of a key and its parameters on the test data."""
    job, params = CATALOG[key]
    return job, params | TEST_PARAMS.get(key, {})


test_job.__test__ = False  # not a test, whatever its name


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``key -> f(spark, sf_dir)`` over tables derived from ``sf_dir``."""

    def bind(key: str) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            job, params = test_job(key)
            return job(from_tpch(spark, sf_dir), **params)

        query.__name__ = key
        return query

    return {key: bind(key) for key in CATALOG}
