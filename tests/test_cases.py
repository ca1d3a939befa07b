"""Hand-made inputs for cases the generated data does not reach (FIXTURES section 4)."""

from __future__ import annotations

from tests.conftest import D, T, collect
from tiffin.plans import checks
from tiffin.plans import questions as Q

AS_OF = D(2024, 6, 1)


def order(oid, cid=1, rid=1, item="x", date=AS_OF, time=T(12), status="done", amount=10.0):
    return (oid, cid, rid, item, date, time, status, amount)


def test_q01_ties_at_k_keep_all_ranks(make_tables):
    counts = [5, 5, 4, 3, 2, 1, 1]
    orders, oid = [], 0
    for i, c in enumerate(counts):
        for _ in range(c):
            oid += 1
            orders.append(order(oid, item=f"d{i}"))
    t = make_tables(customers=[(1, "A", None)], orders=orders)
    got = sorted(collect(Q.q01_top_dishes(t, "A", AS_OF, 1, 5)), key=lambda r: (r[3], r[1]))
    assert [r[3] for r in got] == [1, 1, 2, 3, 4, 5, 5]
    assert [r[2] for r in got] == [5, 5, 4, 3, 2, 1, 1]


def test_q01_cutoff_inclusive_future_kept_leap_day(make_tables):
    as_of = D(2024, 2, 29)
    orders = [
        order(1, item="on_cutoff", date=D(2023, 2, 28)),
        order(2, item="before", date=D(2023, 2, 27)),
        order(3, item="future", date=D(2025, 1, 1)),
    ]
    t = make_tables(customers=[(1, "A", None)], orders=orders)
    dishes = {r[1] for r in collect(Q.q01_top_dishes(t, "A", as_of, 1, 5))}
    assert dishes == {"on_cutoff", "future"}


def test_q02_slot_edges_and_24h(make_tables):
    times = [T(1, 59, 59), T(2), T(22), T(23, 59, 59), 86400, None]
    t = make_tables(orders=[order(i, time=s) for i, s in enumerate(times)])
    got = dict(collect(Q.q02_time_slots(t)))
    assert got == {"00:00 - 02:00": 1, "02:00 - 04:00": 1, "22:00 - 00:00": 2, None: 2}


def test_q03_groups_by_name_and_strict_threshold(make_tables):
    customers = [(1, "A", None), (2, "A", None), (3, "B", None)]
    orders = [order(i, cid=1) for i in range(8)] + [order(100 + i, cid=2) for i in range(8)]
    orders += [order(200 + i, cid=3, amount=None if i == 0 else 30.0) for i in range(15)]
    t = make_tables(customers=customers, orders=orders)
    got = collect(Q.q03_avg_order_value(t, min_orders=15))
    assert got == [("A", 16, 10.0)]  # B has exactly 15 -> excluded


def test_q04_strict_threshold(make_tables):
    customers = [(1, "A", None), (2, "B", None)]
    orders = [order(1, cid=1, amount=60.0), order(2, cid=1, amount=40.0), order(3, cid=2, amount=100.01)]
    t = make_tables(customers=customers, orders=orders)
    assert collect(Q.q04_high_spenders(t, min_total=100)) == [("B", 100.01)]


def test_q05_status_ignored_unknown_restaurant_kept(make_tables):
    restaurants = [(1, "R1", "C1", None)]
    orders = [order(1, rid=1), order(2, rid=1), order(3, rid=99), order(4, rid=1)]
    deliveries = [(10, 1, "Delivered", T(13), 1), (20, 2, "Returned", T(13), 1)]
    t = make_tables(restaurants=restaurants, orders=orders, deliveries=deliveries)
    got = set(collect(Q.q05_undelivered(t)))
    assert got == {("R1", "C1", 1), (None, None, 1)}


def test_q06_null_revenue_ranks_first(make_tables):
    restaurants = [(1, "R1", "C", None), (2, "R2", "C", None)]
    orders = [order(1, rid=1, amount=None), order(2, rid=2, amount=50.0)]
    t = make_tables(restaurants=restaurants, orders=orders)
    assert collect(Q.q06_top_restaurant_by_city(t, AS_OF, 1, 1)) == [("C", "R1", None, 1)]
    full = sorted(collect(Q.q06_top_restaurant_by_city(t, AS_OF, 1, None)), key=lambda r: r[3])
    assert [(r[1], r[3]) for r in full] == [("R1", 1), ("R2", 2)]


def test_q07_tie_at_top_keeps_both(make_tables):
    restaurants = [(1, "R1", "C", None)]
    orders = [order(1, item="a"), order(2, item="a"), order(3, item="b"), order(4, item="b"), order(5, item="c")]
    t = make_tables(restaurants=restaurants, orders=orders)
    got = sorted(collect(Q.q07_top_dish_by_city(t)))
    assert got == [("C", "a", 2, 1), ("C", "b", 2, 1)]


def test_q08_null_in_absent_year_empties_result(make_tables):
    orders = [order(1, cid=1, date=D(2023, 5, 1)), order(2, cid=None, date=D(2024, 5, 1)),
              order(3, cid=2, date=D(2024, 5, 1))]
    t = make_tables(orders=orders)
    assert collect(Q.q08_lapsed_customers(t, 2023, 2024)) == []


def test_q08_null_in_active_year(make_tables):
    active = [order(1, cid=1, date=D(2023, 5, 1)), order(2, cid=None, date=D(2023, 5, 1))]
    # absent year has rows (no NULL): NULL customer excluded, customer 1 kept
    t = make_tables(orders=active + [order(3, cid=2, date=D(2024, 1, 1))])
    assert collect(Q.q08_lapsed_customers(t, 2023, 2024)) == [(1,)]
    # absent year empty: NOT IN an empty set is true, NULL included
    t = make_tables(orders=active)
    assert sorted(collect(Q.q08_lapsed_customers(t, 2023, 2024)), key=str) == [(1,), (None,)]


def test_q09_fan_out_and_both_years(make_tables):
    orders = [
        order(1, rid=1, date=D(2023, 3, 1)),  # 3 deliveries -> 3 rows
        order(2, rid=1, date=D(2023, 3, 2)),  # no delivery -> 1 row, not delivered
        order(3, rid=1, date=D(2024, 3, 1)),  # returned delivery still a delivery row
        order(4, rid=2, date=D(2023, 3, 1)),  # restaurant 2 only in 2023
    ]
    deliveries = [(11, 1, "Delivered", T(13), 1), (12, 1, "Delivered", T(13), 1),
                  (13, 1, "Delivered", T(13), 1), (31, 3, "Returned", T(13), 1)]
    t = make_tables(orders=orders, deliveries=deliveries)
    assert collect(Q.q09_cancellation_rate(t, 2023, 2024)) == [(1, 25.0, 0.0)]


def test_q10_midnight_and_same_time(make_tables):
    orders = [order(1, time=T(23, 50)), order(2, time=T(12)), order(3, time=None)]
    deliveries = [(1, 1, "Delivered", T(0, 10), 7), (2, 2, "Delivered", T(12), 7),
                  (3, 3, "Delivered", T(1), 7), (4, 2, "Returned", T(13), 7)]
    t = make_tables(orders=orders, deliveries=deliveries)
    got = {r[1]: r for r in collect(Q.q10_delivery_minutes(t))}
    assert got[1] == (7, 1, T(23, 50), T(0, 10), -(23 * 3600 + 40 * 60), 20.0)
    assert got[2][4:] == (0, 0.0)
    assert got[3][4:] == (None, None)
    assert len(got) == 3


def test_q11_previous_present_month(make_tables):
    orders = [order(1, rid=5, date=D(2024, 1, 10)), order(2, rid=5, date=D(2024, 3, 10)),
              order(3, rid=5, date=D(2024, 3, 11)), order(4, rid=5, date=D(2024, 3, 12))]
    deliveries = [(i, i, "Delivered", T(13), 1) for i in (1, 2, 3, 4)]
    t = make_tables(orders=orders, deliveries=deliveries)
    got = sorted(collect(Q.q11_monthly_growth(t)))
    assert got == [(5, 2024, 1, 1, None, None), (5, 2024, 3, 3, 1, 200.0)]


def test_q11_negative_growth_rounds_half_away_from_zero(make_tables):
    # 32 -> 31 orders: -3.125 % -> -3.13
    orders = [order(i, rid=1, date=D(2024, 1, 1)) for i in range(32)]
    orders += [order(100 + i, rid=1, date=D(2024, 2, 1)) for i in range(31)]
    deliveries = [(o[0], o[0], "Delivered", T(13), 1) for o in orders]
    t = make_tables(orders=orders, deliveries=deliveries)
    got = sorted(collect(Q.q11_monthly_growth(t)))
    assert got[1][5] == -3.13


def test_q12_null_spend_is_silver(make_tables):
    orders = [order(1, cid=1, amount=None), order(2, cid=2, amount=100.0), order(3, cid=3, amount=1.0)]
    t = make_tables(orders=orders)
    got = dict((r[0], r[1:]) for r in collect(Q.q12_segments(t)))
    # average order = 50.5: customer 2 is Gold; 1 (NULL) and 3 are silver
    assert got == {"Gold": (1, 100.0), "silver": (2, 1.0)}


def test_q13_counts_every_status_and_text_month(make_tables):
    orders = [order(1, amount=100.0, date=D(2024, 12, 5)), order(2, amount=50.0, date=D(2025, 1, 5))]
    deliveries = [(1, 1, "Delivered", T(13), 3), (2, 1, "Returned", T(13), 3), (3, 2, "Delivered", T(13), 3)]
    t = make_tables(orders=orders, deliveries=deliveries)
    got = collect(Q.q13_rider_earnings(t))
    assert got == [(3, "01-25", 50.0, 4.0), (3, "12-24", 200.0, 16.0)]


def test_audits_find_one_violation_each(make_tables):
    customers = [(1, "A" * 26, None), (1, "B", None), (None, "C", None)]
    orders = [order(1, cid=1), order(2, cid=42), order(3, cid=None)]
    t = make_tables(customers=customers, orders=orders)
    pk = {r[1]: r[3] for r in collect(checks.pk_audit(t))}
    assert pk["customers"] == 2  # one duplicated value + one NULL key
    assert pk["orders"] == 0
    fk = {r[0]: r[3] for r in collect(checks.fk_audit(t))}
    assert fk["fk_customers"] == 1  # 42 dangling; NULL reference allowed
    ln = {(r[1], r[2]): r[3] for r in collect(checks.varchar_audit(t))}
    assert ln[("customers", "customer_name")] == 1
    assert sum(ln.values()) == 1


def test_null_profile_and_cleanup(make_tables):
    orders = [order(1), order(2, item=None), order(3, amount=None)]
    t = make_tables(orders=orders)
    assert checks.null_rows_orders(t).count() == 2
    assert [r[0] for r in collect(checks.drop_null_orders(t))] == [1, 3]


def test_report_matches_standalone_questions(spark):
    from tests.conftest import SF001
    from tiffin.plans.catalog import TEST_AS_OF, TEST_CUSTOMER
    from tiffin.plans.report import report
    from tiffin.sources import from_tpch

    t = from_tpch(spark, SF001)
    params = dict(as_of=TEST_AS_OF, customer_name=TEST_CUSTOMER, min_orders=15, min_total=4_000_000,
                  active_year=2000, absent_year=2001, previous_year=2000, current_year=2001)
    shared = report(t, **params)
    alone = {
        "q03_avg_order_value": Q.q03_avg_order_value(t, 15),
        "q04_high_spenders": Q.q04_high_spenders(t, 4_000_000),
        "q12_segments": Q.q12_segments(t),
        "q05_undelivered": Q.q05_undelivered(t),
        "q09_cancellation_rate": Q.q09_cancellation_rate(t, 2000, 2001),
        "q11_monthly_growth": Q.q11_monthly_growth(t),
        "q13_rider_earnings": Q.q13_rider_earnings(t),
        "q10_delivery_minutes": Q.q10_delivery_minutes(t),
    }
    for key, df in alone.items():
        assert sorted(collect(shared[key]), key=str) == sorted(collect(df), key=str), key


def test_q09_zero_denominator_is_null(make_tables):
    # Only a NULL order id in the previous year: COUNT(o.order_id) = 0.  The
    # original database raises a division error; the job returns NULL.
    orders = [order(None, rid=1, date=D(2023, 3, 1)), order(2, rid=1, date=D(2024, 3, 1))]
    t = make_tables(orders=orders, deliveries=[(1, 2, "Delivered", T(13), 1)])
    assert collect(Q.q09_cancellation_rate(t, 2023, 2024)) == [(1, None, 0.0)]
