"""Derive the five marketplace tables from TPC-H-style inputs.

The test data the project is checked on is a TPC-H-like star schema
(``customer supplier nation part orders lineitem``).  This module maps it to
customers, restaurants, orders, riders and deliveries.  Every column is a
row-local expression; the only lookups are the nation name and the dish name,
which is the name of any part.  Key ranges follow the row counts of the inputs (scalar
subqueries), so every table grows with them.  NULLs are injected on purpose,
because the inputs have none and the questions must handle them.

Each derived table already has the declared column names, order and types
(``tests/test_entry.py`` checks them against ``SCHEMAS``), so no extra
conforming projection is added per query.
"""

from __future__ import annotations

import datetime as dt
import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.sources.tables import Tables

# Fixed values of the derivation (they define the test fixture, so the SQL
# oracle uses the same numbers).
REG_DATE_BASE = dt.date(1995, 1, 1)  # customers.reg_date = base - (id % 365) days
SIGN_UP_BASE = dt.date(1994, 1, 1)   # riders.sign_up = base + rider_id days
OPENING_HOURS = "10:00 - 22:00"
NULL_REG_DATE_EVERY = 97
NULL_ITEM_EVERY = 101
NULL_AMOUNT_EVERY = 103
NULL_TIME_EVERY = 107


# The input columns the derivation reads, with the types the
# test tables have (FIXTURES section 2).  Declaring them skips Spark's schema
# inference -- a footer-reading job per table per query -- and makes the
# Parquet scan read exactly these columns.
INPUT_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz"),
    "lineitem": ("l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_returnflag string"),
}


def read_tpch(spark: SparkSession, sf_dir: str, name: str, infer_schema: bool = False) -> DataFrame:
    """One input table; with ``infer_schema`` the file's own schema is used
    (for inputs whose types differ from ``INPUT_SCHEMAS``)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    if infer_schema:
        return spark.read.parquet(path)
    return spark.read.schema(INPUT_SCHEMAS[name]).parquet(path)


def row_count(table: DataFrame) -> F.Column:
    """The number of rows, NULL if there are none (so that ``x % n`` is NULL)."""
    return table.select(F.nullif(F.count(F.lit(1)), F.lit(0))).scalar()


def derive_customers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    reg_date = F.when(key % NULL_REG_DATE_EVERY != 0,
                      F.date_sub(F.lit(REG_DATE_BASE), (key % 365).cast("int")))
    return customer.select(
        key.alias("customer_id"), F.col("c_name").alias("customer_name"), reg_date.alias("reg_date")
    )


def derive_restaurants(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    # Two columns of a file of a few kB: the planner broadcasts it by its size.
    cities = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    hours = F.when(~(F.col("s_acctbal") < 0) | F.col("s_acctbal").isNull(), F.lit(OPENING_HOURS))
    return supplier.join(cities, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("restaurant_id"),
        F.col("s_name").alias("restaurant_name"),
        "city",
        hours.alias("opening_hours"),
    )


def derive_orders(orders: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    # Numbers of restaurants and parts: scalar subqueries, evaluated once per query.
    n_restaurants, n_parts = row_count(supplier), row_count(part)
    # Parts grow with the data, so nothing is forced: the planner broadcasts
    # them while they are small and shuffles both sides (on a key that spreads
    # evenly) once they are not.  Grouping by the key (which is unique) tells
    # the planner so, and it drops the join where no dish is asked for.
    dishes = part.groupBy(F.col("p_partkey").alias("dish_key")).agg(F.min("p_name").alias("p_name"))
    joined = orders.withColumn("dish_key", (key * 13 + cust) % n_parts).join(dishes, "dish_key", "left")
    return joined.select(
        key.alias("order_id"),
        cust.alias("customer_id"),
        ((key * 7 + cust) % n_restaurants).alias("restaurant_id"),
        F.when(key % NULL_ITEM_EVERY != 0, F.col("p_name")).alias("order_item"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(key % NULL_TIME_EVERY != 0, (key * 7919) % 86400).alias("order_time"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(key % NULL_AMOUNT_EVERY != 0, F.col("o_totalprice")).alias("total_amount"),
    )


def derive_riders(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("rider_id"),
        F.col("n_name").alias("rider_name"),
        F.date_add(F.lit(SIGN_UP_BASE), F.col("n_nationkey")).alias("sign_up"),
    )


def derive_deliveries(lineitem: DataFrame, nation: DataFrame) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    time = ((key * 7919) % 86400 + 300 + F.col("l_quantity").cast("bigint") * 60 + line * 47) % 86400
    status = F.when(F.col("l_returnflag") == "R", F.lit("Returned")).otherwise(F.lit("Delivered"))
    return lineitem.select(
        (key * 10 + line).alias("delivery_id"),
        key.alias("order_id"),
        status.alias("delivery_status"),
        time.alias("delivery_time"),
        (F.col("l_suppkey") % row_count(nation)).alias("rider_id"),
    )


def from_tpch(spark: SparkSession, sf_dir: str) -> Tables:
    """The five marketplace tables derived from ``{sf_dir}/*.parquet``."""
    @functools.cache
    def read(name: str) -> DataFrame:
        return read_tpch(spark, sf_dir, name)

    return Tables(
        customers=lambda: derive_customers(read("customer")),
        restaurants=lambda: derive_restaurants(read("supplier"), read("nation")),
        orders=lambda: derive_orders(read("orders"), read("supplier"), read("part")),
        riders=lambda: derive_riders(read("nation")),
        deliveries=lambda: derive_deliveries(read("lineitem"), read("nation")),
    )
