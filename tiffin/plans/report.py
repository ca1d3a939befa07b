"""All questions in one batch, sharing the order-delivery facts.

Three fact tables are built once, written as Parquet to the shared checkpoint
folder, and shared:

* order facts -- orders joined to per-order delivery counts -- answer Q5,
  Q9 and Q11, which run one by one would each shuffle deliveries and orders;
* customer facts -- orders counted and summed per customer -- answer Q3, Q4
  and Q12 (its average order amount included: the exact per-customer sums
  add up to the exact total), which would each scan and aggregate orders.

* delivery facts -- every delivery joined to its order -- answer Q10 and
  Q13, which would each shuffle deliveries and orders for the same join.

The other questions read the base tables as usual.
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.plans import checks
from tiffin.plans import questions as Q
from tiffin.functions import money_value, sums_again
from tiffin.sources import Intermediates, Tables


def shared_order_facts(t: Tables, status: str = Q.DELIVERED) -> DataFrame:
    """orders LEFT JOIN per-order delivery counts, unmaterialised."""

    def facts(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        return Q.order_facts(orders.select("order_id", "restaurant_id", "order_date"), deliveries, status=status, how="left")

    return t.by_order(facts)


def shared_delivery_facts(t: Tables) -> DataFrame:
    """Every delivery joined to its order (deliveries stream, orders buffer),
    with the columns Q10 and Q13 need, unmaterialised."""

    def joined(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        deliveries = deliveries.select("order_id", "rider_id", "delivery_status", "delivery_time")
        return deliveries.join(orders.select("order_id", "order_time", "order_date", "total_amount"), "order_id")

    return t.by_order(joined)


def report(
    t: Tables,
    as_of: dt.date | str | None = None,
    customer_name: str = Q.DEFAULT_CUSTOMER,
    years: int = 1,
    k: int = Q.DEFAULT_TOP_K,
    min_orders: int = Q.DEFAULT_MIN_ORDERS,
    min_total: float = Q.DEFAULT_MIN_TOTAL,
    active_year: int = 2023,
    absent_year: int = 2024,
    previous_year: int = 2023,
    current_year: int = 2024,
    status: str = Q.DELIVERED,
    multiple: float = 1,
    share: str | float | Decimal = Q.DEFAULT_RIDER_SHARE,
    work: Intermediates | None = None,
) -> dict[str, DataFrame]:
    """Every question (and the quality checks) as lazy DataFrames.

    With ``work`` the three shared fact tables are written once, here, and go
    when that context ends; without it the questions share only their plans.
    """
    facts = shared_order_facts(t, status)
    per_customer = Q.customer_facts(t.orders)
    per_delivery = shared_delivery_facts(t)
    if work is not None:
        facts = work.write(facts, "order_facts")
        per_customer = work.write(per_customer, "customer_facts")
        per_delivery = work.write(per_delivery, "delivery_facts")
    per_name = Q.totals_per_name_from_facts(per_customer, t.customers, memo=t.checked)
    overall = per_customer.agg(*Q.named(sums_again("spent")), F.sum("n_amounts").alias("n"))
    avg_amount = overall.select(
        F.when(F.col("n") > 0, money_value("spent") / F.col("n").cast("double")).alias("avg_amount")
    ).scalar()
    return {
        "null_count_customers": checks.null_count_customers(t),
        "null_count_restaurants": checks.null_count_restaurants(t),
        "null_rows_orders": checks.null_rows_orders(t),
        "pk_audit": checks.pk_audit(t),
        "fk_audit": checks.fk_audit(t),
        "length_audit": checks.varchar_audit(t),
        "q01_top_dishes": Q.q01_top_dishes(t, customer_name, as_of, years, k),
        "q02_time_slots": Q.q02_time_slots(t),
        "q03_avg_order_value": Q.avg_order_value_from_totals(per_name, min_orders),
        "q04_high_spenders": Q.high_spenders_from_totals(per_name, min_total),
        "q05_undelivered": Q.undelivered_from_facts(facts, t.restaurants),
        "q06_top_restaurant_by_city": Q.q06_top_restaurant_by_city(t, as_of, years),
        "q07_top_dish_by_city": Q.q07_top_dish_by_city(t),
        "q08_lapsed_customers": Q.q08_lapsed_customers(t, active_year, absent_year),
        "q09_cancellation_rate": Q.cancellation_from_facts(facts, previous_year, current_year),
        "q10_delivery_minutes": Q.delivery_minutes_from(per_delivery, status),
        "q11_monthly_growth": Q.growth_from_facts(facts),
        "q12_segments": Q.segments_from_facts(per_customer, multiple, avg_amount),
        "q13_rider_earnings": Q.rider_earnings(per_delivery, share),
    }


def write_report(results: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> None:
    """Write each result as Parquet under ``out_dir/<key>``."""
    for key, df in results.items():
        df.write.mode(mode).parquet(os.path.join(out_dir, key))
