"""Declared schemas of the five marketplace tables.

Types follow the reference DDL with three deliberate choices:

* integer keys are ``bigint`` (a superset of ``INT``; inputs with ``int``
  keys are widened on load);
* ``TIME`` columns hold **integral seconds of the day** (``bigint``,
  0..86399, 86400 meaning 24:00:00), because Spark's ``TIME`` type is off by
  default and cannot be written to Parquet;
* ``FLOAT`` is ``double`` (an unqualified SQL ``FLOAT`` is 8 bytes).

``VARCHAR(n)`` limits are not types in Spark; they are kept in
``VARCHAR_LIMITS`` and checked by the length audit.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _F = T.LongType(), T.StringType(), T.DateType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _struct(
    ("customer_id", _L, True),
    ("customer_name", _S, True),
    ("reg_date", _D, True),
)
RESTAURANTS = _struct(
    ("restaurant_id", _L, True),
    ("restaurant_name", _S, True),
    ("city", _S, True),
    ("opening_hours", _S, True),
)
ORDERS = _struct(
    ("order_id", _L, True),
    ("customer_id", _L, True),
    ("restaurant_id", _L, True),
    ("order_item", _S, True),
    ("order_date", _D, True),
    ("order_time", _L, True),
    ("order_status", _S, True),
    ("total_amount", _F, True),
)
RIDERS = _struct(
    ("rider_id", _L, True),
    ("rider_name", _S, True),
    ("sign_up", _D, True),
)
DELIVERIES = _struct(
    ("delivery_id", _L, True),
    ("order_id", _L, True),
    ("delivery_status", _S, True),
    ("delivery_time", _L, True),
    ("rider_id", _L, True),
)

SCHEMAS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "restaurants": RESTAURANTS,
    "orders": ORDERS,
    "riders": RIDERS,
    "deliveries": DELIVERIES,
}

#: Columns that hold a time of day.
TIME_COLUMNS = ("order_time", "delivery_time")

# Fixed values from the reference DDL: primary keys, foreign keys (constraint
# name, child table, child column, parent table, parent column) and VARCHAR(n)
# limits (table, column, n).
PRIMARY_KEYS = [
    ("customers", "customer_id"),
    ("restaurants", "restaurant_id"),
    ("orders", "order_id"),
    ("riders", "rider_id"),
    ("deliveries", "delivery_id"),
]
FOREIGN_KEYS = [
    ("fk_restaurants", "orders", "restaurant_id", "restaurants", "restaurant_id"),
    ("fk_customers", "orders", "customer_id", "customers", "customer_id"),
    ("fk_orders", "deliveries", "order_id", "orders", "order_id"),
    ("fk_riders", "deliveries", "rider_id", "riders", "rider_id"),
]
VARCHAR_LIMITS = [
    ("customers", "customer_name", 25),
    ("restaurants", "restaurant_name", 55),
    ("restaurants", "city", 25),
    ("restaurants", "opening_hours", 55),
    ("orders", "order_item", 55),
    ("orders", "order_status", 55),
    ("riders", "rider_name", 55),
    ("deliveries", "delivery_status", 35),
]
