"""Spot values and invariants on the sf0.01 tables (FIXTURES section 3, SURVEY section 5)."""

from __future__ import annotations

import pytest

from tests.conftest import SF01, collect
from tiffin.plans import test_job
from tiffin.sources import from_tpch


def run(key, tables):
    job, params = test_job(key)
    return job(tables, **params)


@pytest.fixture(scope="module")
def t(spark):
    return from_tpch(spark, SF01)


def test_q02_slots(t):
    slots = dict(collect(run("q02_time_slots", t)))
    assert len(slots) == 13 and None in slots
    assert slots["00:00 - 02:00"] == 1238
    assert sum(slots.values()) == 15000  # every non-NULL order id, NULL slot included


def test_q03_customer5(t):
    rows = {r[0]: r[1:] for r in collect(run("q03_avg_order_value", t))}
    assert rows["Customer#000000005"] == (19, 226837.37736842106)


def test_q05_total(t):
    assert sum(r[2] for r in collect(run("q05_undelivered", t))) == 257


def test_q06_leader(t):
    rows = collect(run("q06_top_restaurant_by_city", t))
    assert ("NATION_7", "Supplier#000000094", 9024205.19, 1) in rows


def test_q09_nonzero(t):
    rows = collect(run("q09_cancellation_rate", t))
    assert sum(1 for r in rows if r[1] or r[2]) == 49


def test_q10_midnight_and_nulls(t):
    df = run("q10_delivery_minutes", t)
    assert df.filter("time_difference < 0").count() == 874
    assert df.filter("order_time IS NULL").count() == 367


def test_q11_restaurant0(t):
    rows = sorted(r for r in collect(run("q11_monthly_growth", t)) if r[0] == 0)
    assert rows[0] == (0, 1995, 1, 6, None, None)
    assert rows[1] == (0, 1995, 2, 10, 6, 66.67)
    assert run("q11_monthly_growth", t).filter("growth_rat IS NULL").count() == 100


def test_q12_segments(t):
    assert sorted(collect(run("q12_segments", t))) == [("Gold", 14998, 3721076927.71), ("silver", 2, 64377.5)]
    assert sorted(collect(run("q12_segments_10x", t))) == [
        ("Gold", 8657, 2274050135.48), ("silver", 6343, 1447091169.73)]


def test_q13_earnings_are_share_of_revenue(t):
    for rider, month, revenue, earning in collect(run("q13_rider_earnings", t)):
        assert earning == pytest.approx(0.08 * revenue, rel=1e-12)


def test_audits(t):
    pk = {r[1]: r[3] for r in collect(run("pk_audit", t))}
    assert pk == {"customers": 0, "restaurants": 0, "orders": 0, "riders": 0, "deliveries": 11785}
    assert all(r[3] == 0 for r in collect(run("fk_audit", t)))
    assert all(r[3] == 0 for r in collect(run("length_audit", t)))
    assert collect(run("null_count_customers", t)) == [(16,)]
    assert collect(run("null_count_restaurants", t)) == [(6,)]


def test_report_equals_every_standalone_job(spark, t):
    from tiffin.plans.catalog import TEST_AS_OF, TEST_CUSTOMER
    from tiffin.plans.report import report

    shared = report(t, as_of=TEST_AS_OF, customer_name=TEST_CUSTOMER, min_orders=15, min_total=4_000_000,
                    active_year=2000, absent_year=2001, previous_year=2000, current_year=2001)
    for key, df in shared.items():
        job, params = test_job(key)
        assert sorted(collect(df), key=str) == sorted(collect(job(t, **params)), key=str), key
