"""The thirteen business questions.

Each question takes the five tables (:class:`tiffin.sources.Tables`) and
keyword parameters whose defaults are the literals of the original
worksheet, and returns a lazy DataFrame.

Design rules applied throughout (the plans must hold at 100 TB):

* **Small lookups are broadcast only after a check of rows and bytes.**  Q1's
  named customers and the customers/restaurants lookups of Q3, Q4, Q6 and Q7
  are measured first (one global aggregate for each lookup of a ``Tables``); under the bounds they are
  broadcast and the orders are filtered and joined where they are read, with
  no shuffle of orders at all (:mod:`tiffin.operators.broadcast`,
  :mod:`tiffin.operators.lookup`).
* **Otherwise aggregate before joining.**  Facts are reduced to one row per
  join key (partial, map-side aggregation) before they meet another table;
  the aggregation's exchange is on the join key, so the join reuses it.
  COUNT and SUM are distributive, so the result is exact, join fan-out
  included, and a customer, order or restaurant holding a third of all rows
  becomes one partial row per task instead of a hot reducer.  Deliveries are
  always reduced per order this way for Q5, Q9 and Q11.
* **Join first when the output key is tiny or the output is per row.**  Q13
  aggregates to (rider, month) and Q10 emits every delivery: both join
  deliveries to orders directly, deliveries streaming on the left (AQE
  splits a hot order's partition) and orders, unique per id, buffered.
* **One-row aggregates are scalar subqueries** (the NOT IN summary, Q12's
  average), evaluated once and inlined: no join.  Everything else is left to
  Spark's own size thresholds.
* **Filters as ranges.**  Year and cut-off filters are written as date
  ranges against literals, which Parquet uses to skip row groups.
* **Exact arithmetic.**  Amounts are summed as decimals, binned by the
  size of their digits, NaN and infinite ones beside them; percentages are
  rounded with integer arithmetic (see :mod:`tiffin.functions.money`).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffin.functions import (
    in_any_year,
    in_year,
    money_sums,
    money_value,
    month_text,
    rounded_ratio,
    slot_label,
    sums_again,
    time_difference,
    wrapped_seconds,
    year_range,
    years_before,
)
from tiffin.operators import broadcast_if_small, keep_top_ranks, not_in, order_key, rollup_through_lookup
from tiffin.sources import Tables

DateLike = dt.date | str | None

# Fixed values of the original worksheet (its literals become the defaults).
DEFAULT_CUSTOMER = "Arjun Mehta"
DEFAULT_TOP_K = 5
DEFAULT_MIN_ORDERS = 750
DEFAULT_MIN_TOTAL = 100000
DEFAULT_RIDER_SHARE = "0.08"
DELIVERED = "Delivered"
GOLD, SILVER = "Gold", "silver"

# Lookup tables (customers, restaurants) with at most this many rows (and
# operators.broadcast.DEFAULT_MAX_BYTES bytes) are broadcast after a check;
# larger ones take the shuffle plan.
DEFAULT_LOOKUP_ROWS = 500_000


# ---------------------------------------------------------------- helpers


def delivery_profile(
    deliveries: DataFrame,
    status: str = DELIVERED,
    only_status: bool = False,
) -> DataFrame:
    """Deliveries reduced to one row per ``order_id``:

    * ``d_rows``: delivery rows;
    * ``d_idless``: rows among them whose ``delivery_id`` is NULL;
    * ``d_status``: rows whose ``delivery_status`` is ``status``.

    Deliveries are not unique per order, so this is the fan-out an
    ``orders JOIN deliveries`` would produce, computed with a partial
    aggregation before the shuffle on ``order_id``.  That exchange is
    ``hashpartitioning(order_id)``, exactly what the following sort-merge
    join on ``order_id`` requires, so the join adds no second shuffle of
    deliveries.  ``only_status`` drops the other deliveries before
    aggregating.
    """
    d = deliveries.filter(F.col("order_id").isNotNull())
    if only_status:
        d = d.filter(F.col("delivery_status") == F.lit(status))
    return d.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("d_rows"),
        F.count_if(F.col("delivery_id").isNull()).alias("d_idless"),
        F.count_if(F.col("delivery_status") == F.lit(status)).alias("d_status"),
    )


def order_facts(
    orders: DataFrame,
    deliveries: DataFrame,
    status: str = DELIVERED,
    only_status: bool = False,
    how: str = "left",
) -> DataFrame:
    """``orders`` joined (``how``) to :func:`delivery_profile` on
    ``order_id``.  With a left join, orders without deliveries keep NULL
    profile columns.  The profile is unique per ``order_id``, so it is the
    buffered side of the join and cannot multiply order rows; a hot order is
    one profile row.  The Q5/Q9/Q11 cores below read these facts, and the
    batch report builds them once for all three.
    """
    profile = delivery_profile(deliveries, status=status, only_status=only_status)
    return orders.join(profile, "order_id", how)


def _joined_rows() -> F.Column:
    """Rows an ``orders LEFT JOIN deliveries`` yields for a fact row (1 when
    the order has no delivery)."""
    return F.when(F.col("d_rows").isNotNull(), F.col("d_rows")).otherwise(F.lit(1)).cast("bigint")


def _idless_rows() -> F.Column:
    """Those rows having ``delivery_id IS NULL`` (1 when unmatched: the padded
    side is all NULL)."""
    return F.when(F.col("d_rows").isNotNull(), F.col("d_idless")).otherwise(F.lit(1)).cast("bigint")


def undelivered_from_facts(facts: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Q5 core over left-join order facts (order_id, restaurant_id, d_*)."""
    kept = facts.withColumn("idless_rows", _idless_rows()).filter(F.col("idless_rows") > 0)
    # COUNT(o.order_id) over the surviving rows (NULL order ids not counted).
    counted = F.when(F.col("order_id").isNotNull(), F.col("idless_rows")).otherwise(F.lit(0))
    per_restaurant = kept.groupBy("restaurant_id").agg(F.sum(counted).alias("n"))
    named = per_restaurant.join(
        restaurants.select("restaurant_id", "restaurant_name", "city"), "restaurant_id", "left"
    )
    return (
        named.groupBy("restaurant_name", "city")
        .agg(F.sum("n").cast("bigint").alias("cnt_not_delivered_orders"))
        .orderBy(order_key("cnt_not_delivered_orders"))
    )


def cancellation_from_facts(facts: DataFrame, previous_year: int, current_year: int) -> DataFrame:
    """Q9 core over left-join order facts (order_id, restaurant_id, order_date, d_*)."""
    j = facts.filter(in_any_year(F.col("order_date"), [previous_year, current_year]))
    joined, idless = _joined_rows(), _idless_rows()
    counted = F.when(F.col("order_id").isNotNull(), joined).otherwise(F.lit(0))

    def in_y(year: int, value: F.Column) -> F.Column:
        return F.sum(F.when(in_year(F.col("order_date"), year), value))

    per_restaurant = j.groupBy("restaurant_id").agg(
        in_y(previous_year, joined).alias("rows_p"),
        in_y(previous_year, counted).alias("total_p"),
        in_y(previous_year, idless).alias("idless_p"),
        in_y(current_year, joined).alias("rows_c"),
        in_y(current_year, counted).alias("total_c"),
        in_y(current_year, idless).alias("idless_c"),
    )
    both = per_restaurant.filter(
        F.col("restaurant_id").isNotNull() & (F.col("rows_p") > 0) & (F.col("rows_c") > 0)
    )
    return both.select(
        "restaurant_id",
        rounded_ratio(F.col("idless_p"), F.col("total_p"), multiplier=100).alias("cancel_rat23"),
        rounded_ratio(F.col("idless_c"), F.col("total_c"), multiplier=100).alias("cancel_rat24"),
    )


def growth_from_facts(facts: DataFrame) -> DataFrame:
    """Q11 core over order facts (order_id, restaurant_id, order_date, d_status)."""
    delivered = facts.filter(F.col("d_status") > 0)
    monthly = delivered.groupBy(
        "restaurant_id",
        F.year("order_date").cast("bigint").alias("year1"),
        F.month("order_date").cast("bigint").alias("month1"),
    ).agg(F.sum("d_status").alias("month_orders"))
    w = Window.partitionBy("restaurant_id").orderBy(
        F.col("year1").asc_nulls_last(), F.col("month1").asc_nulls_last()
    )
    prev = F.lag("month_orders", 1).over(w)
    return monthly.withColumn("prev_month_orders", prev).select(
        "restaurant_id",
        "year1",
        "month1",
        "month_orders",
        "prev_month_orders",
        rounded_ratio(
            F.col("month_orders") - F.col("prev_month_orders"), F.col("prev_month_orders"), multiplier=100
        ).alias("growth_rat"),
    )


def rider_earnings(delivered_orders: DataFrame, share: str | float | Decimal) -> DataFrame:
    """Q13 core over one row per delivery carrying its order's
    ``order_date`` and ``total_amount`` (deliveries joined to orders)."""
    monthly = delivered_orders.groupBy("rider_id", month_text(F.col("order_date")).alias("month1")).agg(
        *named(money_sums(F.col("total_amount"), "revenue"))
    )
    return monthly.select(
        "rider_id",
        "month1",
        money_value("revenue").alias("revenue"),
        (money_value("revenue") * F.lit(float(share))).alias("riders_earning"),
    ).orderBy(F.col("rider_id").asc_nulls_last(), F.col("month1").asc_nulls_last())


def delivery_minutes_from(delivered_orders: DataFrame, status: str, as_interval: bool = False) -> DataFrame:
    """Q10 core over one row per delivery carrying its order's ``order_time``
    (deliveries joined to orders)."""
    d = delivered_orders.filter(F.col("delivery_status") == F.lit(status))
    o_t, d_t = F.col("order_time"), F.col("delivery_time")
    return d.select(
        "rider_id",
        "order_id",
        "order_time",
        "delivery_time",
        time_difference(d_t, o_t, as_interval).alias("time_difference"),
        rounded_ratio(wrapped_seconds(d_t, o_t), F.lit(60)).alias("time_difference_minutes"),
    )


def customer_facts(orders: DataFrame) -> DataFrame:
    """Orders reduced to one row per ``customer_id``: ``n_orders``
    (COUNT(order_id)), ``spent`` (the bins of a money sum) and
    ``n_amounts`` (COUNT(total_amount)).  Q3, Q4 and Q12 can all be answered from it."""
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("n_orders"),
        *named(money_sums(F.col("total_amount"), "spent")),
        F.count("total_amount").alias("n_amounts"),
    )


def totals_per_name_from_facts(
    facts: DataFrame,
    customers: DataFrame,
    lookup_rows: int = DEFAULT_LOOKUP_ROWS,
    memo: dict[int, tuple[int, int]] | None = None,
) -> DataFrame:
    """Per customer *name*: total_orders, spent, n_amounts, from customer facts."""
    return rollup_through_lookup(
        facts,
        customers.select("customer_id", "customer_name"),
        "customer_id",
        ["customer_name"],
        {"total_orders": F.sum("n_orders"), **sums_again("spent"), "n_amounts": F.sum("n_amounts")},
        lookup_rows,
        memo,
    )


def avg_order_value_from_totals(per_name: DataFrame, min_orders: int) -> DataFrame:
    """Q3 core over per-name totals."""
    kept = per_name.filter(F.col("total_orders") > F.lit(min_orders))
    avg = F.when(F.col("n_amounts") > 0, money_value("spent") / F.col("n_amounts").cast("double"))
    return kept.select("customer_name", "total_orders", avg.alias("avg_money"))


def high_spenders_from_totals(per_name: DataFrame, min_total: float) -> DataFrame:
    """Q4 core over per-name totals."""
    kept = per_name.filter(money_value("spent") > F.lit(float(min_total)))
    return kept.select("customer_name", money_value("spent").alias("total_money"))


def segments_from_facts(facts: DataFrame, multiple: float, avg_amount: F.Column) -> DataFrame:
    """Q12 core over customer facts and the average order amount (a scalar)."""
    threshold = F.lit(float(multiple)) * avg_amount
    labelled = facts.withColumn(
        "category", F.when(money_value("spent") > threshold, F.lit(GOLD)).otherwise(F.lit(SILVER))
    )
    per_category = labelled.groupBy("category").agg(
        F.sum("n_orders").cast("bigint").alias("total_orders"), *named(sums_again("spent"))
    )
    return per_category.select("category", "total_orders", money_value("spent").alias("total_spent"))


def named(measures: dict[str, F.Column]) -> list[F.Column]:
    return [expr.alias(name) for name, expr in measures.items()]


# ---------------------------------------------------------------- questions


def q01_top_dishes(
    t: Tables,
    customer_name: str = DEFAULT_CUSTOMER,
    as_of: DateLike = None,
    years: int = 1,
    k: int = DEFAULT_TOP_K,
    target_max_rows: int = 200_000,
) -> DataFrame:
    """Q1. The customer's most ordered dishes since ``as_of - years``
    (inclusive, no upper bound), dense ranks 1..k, ties kept.

    Output: customer_name, dish, total_orders, rank1.
    """
    # The customers with that name: usually a handful of rows, but the
    # planner only knows the size of the whole customers table.  Broadcast
    # them after a row-count check, so the orders are filtered where they are
    # read and never shuffled; beyond the bound it stays a shuffle join.
    target = broadcast_if_small(
        t.customers.filter(F.col("customer_name") == F.lit(customer_name)).select(
            "customer_id", "customer_name"
        ),
        max_rows=target_max_rows,
        memo=t.checked,
    )
    recent = t.orders_in((years_before(as_of, years), None)).select(
        "customer_id", F.col("order_item").alias("dish")
    )
    per_name = (
        recent.join(target, "customer_id")
        .groupBy("customer_name", "dish")
        .agg(F.count(F.lit(1)).alias("total_orders"))
    )
    ranked = keep_top_ranks(per_name, [], "total_orders", k, method="dense")
    return ranked.select("customer_name", "dish", "total_orders", "rank1")


def q02_time_slots(t: Tables, hours: int = 2) -> DataFrame:
    """Q2. Orders per ``hours``-wide slot of the day, busiest first.  Orders
    without a time form one NULL slot.

    Output: time_slot, order_count.
    """
    return (
        t.orders.select(slot_label(F.col("order_time"), hours).alias("time_slot"), "order_id")
        .groupBy("time_slot")
        .agg(F.count("order_id").alias("order_count"))
        .orderBy(order_key("order_count"))
    )


def _totals_per_customer_name(t: Tables, lookup_rows: int) -> DataFrame:
    return rollup_through_lookup(
        t.orders,
        t.customers.select("customer_id", "customer_name"),
        "customer_id",
        ["customer_name"],
        {
            "total_orders": F.count("order_id"),
            **money_sums(F.col("total_amount"), "spent"),
            "n_amounts": F.count("total_amount"),
        },
        lookup_rows,
        t.checked,
    )


def q03_avg_order_value(
    t: Tables, min_orders: int = DEFAULT_MIN_ORDERS, lookup_rows: int = DEFAULT_LOOKUP_ROWS
) -> DataFrame:
    """Q3. Order count and average order amount per customer *name* with
    more than ``min_orders`` orders (customers sharing a name are merged).

    Output: customer_name, total_orders, avg_money.
    """
    return avg_order_value_from_totals(_totals_per_customer_name(t, lookup_rows), min_orders)


def q04_high_spenders(
    t: Tables, min_total: float = DEFAULT_MIN_TOTAL, lookup_rows: int = DEFAULT_LOOKUP_ROWS
) -> DataFrame:
    """Q4. Customer names whose orders total more than ``min_total``.

    Output: customer_name, total_money.
    """
    return high_spenders_from_totals(_totals_per_customer_name(t, lookup_rows), min_total)


def q05_undelivered(t: Tables) -> DataFrame:
    """Q5. Orders that have no delivery row, counted per restaurant name and
    city (orders of unknown restaurants fall under a NULL name and city).

    Output: restaurant_name, city, cnt_not_delivered_orders.
    """
    facts = t.by_order(lambda o, d: order_facts(o.select("order_id", "restaurant_id"), d))
    return undelivered_from_facts(facts, t.restaurants)


def q06_top_restaurant_by_city(
    t: Tables,
    as_of: DateLike = None,
    years: int = 1,
    keep_rank: int | None = 1,
    lookup_rows: int = DEFAULT_LOOKUP_ROWS,
) -> DataFrame:
    """Q6. Restaurants ranked by revenue since ``as_of - years`` within each
    city (dense rank; a restaurant whose amounts are all NULL ranks first, as
    NULL sorts first when descending).  ``keep_rank=1`` keeps the leaders,
    ``None`` the full ranking.

    Output: city, restaurant_name, revenue, rank1.
    """
    recent = t.orders_in((years_before(as_of, years), None))
    per_name = rollup_through_lookup(
        recent,
        t.restaurants.select("restaurant_id", "city", "restaurant_name"),
        "restaurant_id",
        ["city", "restaurant_name"],
        money_sums(F.col("total_amount"), "revenue"),
        lookup_rows,
        t.checked,
    )
    per_name = per_name.select("city", "restaurant_name", money_value("revenue").alias("revenue"))
    ranked = keep_top_ranks(per_name, ["city"], "revenue", keep_rank, method="dense")
    return ranked.select("city", "restaurant_name", "revenue", "rank1")


def q07_top_dish_by_city(
    t: Tables, keep_rank: int | None = 1, lookup_rows: int = DEFAULT_LOOKUP_ROWS
) -> DataFrame:
    """Q7. The most ordered dish(es) of each city (rank, ties kept; orders
    without an item form a NULL dish that can win).

    Output: city, dish, total_orders, rank1.
    """
    per_city = rollup_through_lookup(
        t.orders.select("restaurant_id", "order_id", F.col("order_item").alias("dish")),
        t.restaurants.select("restaurant_id", "city"),
        "restaurant_id",
        ["city", "dish"],
        {"total_orders": F.count("order_id")},
        lookup_rows,
        t.checked,
    )
    ranked = keep_top_ranks(per_city, ["city"], "total_orders", keep_rank, method="rank")
    return ranked.select("city", "dish", "total_orders", "rank1")


def q08_lapsed_customers(t: Tables, active_year: int = 2023, absent_year: int = 2024) -> DataFrame:
    """Q8. Customers with orders in ``active_year`` and none in
    ``absent_year``, with SQL ``NOT IN`` semantics: a NULL customer id among
    the ``absent_year`` orders empties the result, and if that year has no
    orders at all a NULL customer id of the active year is kept.
    (:func:`tiffin.operators.not_in` is the general form of the same rule.)

    Output: customer_id.
    """

    # One pass instead of two DISTINCT subqueries: per customer id (NULL is
    # a group too), the rows in each year; a hot customer collapses
    # map-side.  x NOT IN S then needs two facts about S, the absent year's
    # ids: is it empty, and does it hold a NULL -- a scan-only aggregate,
    # evaluated once as a scalar subquery.
    o = t.orders_in(year_range(active_year), year_range(absent_year))
    active, absent = in_year(F.col("order_date"), active_year), in_year(F.col("order_date"), absent_year)
    # Presence in each year packed into one small int (bit 1: active year,
    # bit 2: absent year), so each customer shuffles as an id and one flag.
    year_bit = F.when(active, F.lit(1)).otherwise(F.lit(0)) + F.when(absent, F.lit(2)).otherwise(F.lit(0))
    per_customer = o.groupBy("customer_id").agg(F.bit_or(year_bit.cast("tinyint")).alias("years"))
    s_rows_df = t.orders_in(year_range(absent_year)).agg(
        F.count(F.lit(1)).alias("s_rows"), F.count_if(F.col("customer_id").isNull()).alias("s_nulls")
    )
    s_rows, s_nulls = s_rows_df.select("s_rows").scalar(), s_rows_df.select("s_nulls").scalar()
    in_active = F.col("years").bitwiseAND(F.lit(1)) == 1
    in_absent = F.col("years").bitwiseAND(F.lit(2)) == 2
    not_in_s = (s_rows == 0) | (F.col("customer_id").isNotNull() & (s_nulls == 0) & ~in_absent)
    return per_customer.filter(in_active & not_in_s).select("customer_id")


def q08_lapsed_customers_not_in(t: Tables, active_year: int = 2023, absent_year: int = 2024) -> DataFrame:
    """Q8 through the general ``NOT IN`` operator: the same rows as
    :func:`q08_lapsed_customers`, for sets that do not come from one table.

    Output: customer_id.
    """
    active = t.orders_in(year_range(active_year)).select("customer_id").distinct()
    absent = t.orders_in(year_range(absent_year)).select("customer_id")
    return not_in(active, "customer_id", absent, "customer_id")


def q09_cancellation_rate(t: Tables, previous_year: int = 2023, current_year: int = 2024) -> DataFrame:
    """Q9. Share (percent, 2 decimals) of order rows without a delivery row,
    per restaurant, in two years; only restaurants with orders in both.
    Orders with several deliveries count once per delivery, as the original
    left join does.  One scan and one join instead of one per year.

    Output: restaurant_id, cancel_rat23 (previous year), cancel_rat24
    (current year).  The column names are part of the contract and stay the
    same whatever years are passed.
    """
    years = year_range(previous_year), year_range(current_year)

    def facts(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        return order_facts(orders.select("order_id", "restaurant_id", "order_date"), deliveries)

    return cancellation_from_facts(t.by_order(facts, *years), previous_year, current_year)


def q10_delivery_minutes(t: Tables, status: str = DELIVERED, as_interval: bool = False) -> DataFrame:
    """Q10. Delivery time of every delivery with ``status``.

    ``order_time``/``delivery_time`` are seconds of the day;
    ``time_difference`` is the raw difference (negative across midnight), in
    seconds or, ``as_interval``, as a day-time interval; ``time_difference_minutes`` adds a day when the delivery time
    is earlier than the order time, in minutes rounded to 2 decimals.

    Output: rider_id, order_id, order_time, delivery_time, time_difference,
    time_difference_minutes.
    """
    wanted = F.col("delivery_status") == F.lit(status)
    # Deliveries stream, orders (one row per id) are the buffered side.  A
    # hot order's deliveries land in one shuffle partition; AQE's skew-join
    # split (on by default) cuts that partition into several tasks, each
    # joined with the single buffered order row.  Isolating hot keys by hand
    # would need a full count of deliveries per order first -- a second
    # shuffle of deliveries on every run, skewed or not.
    def joined(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        d = deliveries.filter(wanted).select("rider_id", "order_id", "delivery_status", "delivery_time")
        return d.join(orders.select("order_id", "order_time"), "order_id")

    return delivery_minutes_from(t.by_order(joined), status, as_interval)


def q11_monthly_growth(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Q11. Delivered order rows per restaurant and month, and growth in
    percent over the previous month *present in the data* (NULL for a
    restaurant's first month).

    Output: restaurant_id, year1, month1, month_orders, prev_month_orders, growth_rat.
    """
    def facts(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        orders = orders.select("order_id", "restaurant_id", "order_date")
        return order_facts(orders, deliveries, status=status, only_status=True, how="inner")

    return growth_from_facts(t.by_order(facts))


def q12_segments(t: Tables, multiple: float = 1) -> DataFrame:
    """Q12. Customers are 'Gold' when their total spend exceeds ``multiple``
    times the average order amount (over all orders), else 'silver' (NULL
    spend included); orders and spend per label.

    Output: category, total_orders, total_spent.
    """
    # The average over all orders: a scalar subquery (one global aggregate
    # straight over the scan, each task sending one partial row), evaluated
    # once and inlined into the comparison -- no join.
    overall = t.orders.agg(*named(money_sums(F.col("total_amount"), "spent")), F.count("total_amount").alias("n"))
    avg_amount = overall.select(
        F.when(F.col("n") > 0, money_value("spent") / F.col("n").cast("double")).alias("avg_amount")
    ).scalar()
    return segments_from_facts(customer_facts(t.orders), multiple, avg_amount)


def q13_rider_earnings(t: Tables, share: str | float | Decimal = DEFAULT_RIDER_SHARE) -> DataFrame:
    """Q13. Monthly revenue per rider (amounts of the orders they delivered,
    any delivery status) and the rider's ``share`` of it.  Months are
    ``MM-yy`` text, ordered as text like the original.

    Output: rider_id, month1, revenue, riders_earning.
    """
    # Join first: the aggregation key (rider, month) is tiny, so its partial
    # aggregate after the join removes almost everything, and the join's
    # shuffle on order_id is the only large one.  Pre-aggregating per
    # (order, rider) would need a second shuffle, on order_id alone, to join.
    # Deliveries stream (AQE can split a hot order's run); orders, one row
    # per id, are the buffered side.
    def joined(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
        orders = orders.select("order_id", "order_date", "total_amount")
        return deliveries.select("order_id", "rider_id").join(orders, "order_id")

    return rider_earnings(t.by_order(joined), share)
