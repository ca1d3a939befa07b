"""Scans and data-quality jobs over the five tables."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame

from tiffin.operators import bitmaps_pay, drop_null, key_audit, length_audit, null_count, null_rows, reference_audit
from tiffin.sources import Tables
from tiffin.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, VARCHAR_LIMITS

# Fixed values of the original worksheet: the columns each NULL check covers.
CUSTOMER_NULL_COLUMNS = ["customer_name", "reg_date"]
RESTAURANT_NULL_COLUMNS = ["restaurant_name", "city", "opening_hours"]
ORDER_NULL_COLUMNS = ["order_item", "order_date", "order_time", "order_status", "total_amount"]
ORDER_CLEANUP_COLUMNS = ["order_item"]


def scan(t: Tables, table: str) -> DataFrame:
    """``SELECT * FROM table``."""
    return getattr(t, table)


def null_count_customers(t: Tables, cols: list[str] = CUSTOMER_NULL_COLUMNS) -> DataFrame:
    return null_count(t.customers, cols)


def null_count_restaurants(t: Tables, cols: list[str] = RESTAURANT_NULL_COLUMNS) -> DataFrame:
    return null_count(t.restaurants, cols)


def null_rows_orders(t: Tables, cols: list[str] = ORDER_NULL_COLUMNS) -> DataFrame:
    return null_rows(t.orders, cols)


def drop_null_orders(t: Tables, cols: list[str] = ORDER_CLEANUP_COLUMNS) -> DataFrame:
    return drop_null(t.orders, cols)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pk_audit(t: Tables) -> DataFrame:
    """One report row per declared primary key."""
    pay = bitmaps_pay([(getattr(t, table), key) for table, key in PRIMARY_KEYS])
    return _union([key_audit(getattr(t, table), key, table, bitmaps=p) for (table, key), p in zip(PRIMARY_KEYS, pay)])


def fk_audit(t: Tables) -> DataFrame:
    """One report row per declared foreign key."""
    return _union(
        [
            reference_audit(getattr(t, child), ckey, getattr(t, parent), pkey, name, child)
            for name, child, ckey, parent, pkey in FOREIGN_KEYS
        ]
    )


def varchar_audit(t: Tables) -> DataFrame:
    """One report row per declared VARCHAR(n) column; one scan per table."""
    per_table: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for table, col, n in VARCHAR_LIMITS:
        per_table[table].append((col, n))
    return _union([length_audit(getattr(t, table), table, limits) for table, limits in per_table.items()])
