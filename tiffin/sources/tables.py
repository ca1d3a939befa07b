"""Loading and writing the five marketplace tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tiffin.functions import seconds_of_day
from tiffin.sources.schemas import SCHEMAS, TIME_COLUMNS


TABLE_NAMES = ("customers", "restaurants", "orders", "riders", "deliveries")

Source = DataFrame | Callable[[], DataFrame]


#: Partition column of orders written by month: the first day of the order's month.
MONTH = "order_month"

#: Half-open date range; None is no bound on that side.
DateRange = tuple[Column | None, Column | None]


class Tables:
    """The five tables of the marketplace, as lazy DataFrames.

    Each table may be given as a DataFrame or as a zero-argument function
    returning one; functions are called on first access only, so a job that
    reads two tables does not plan (or list files for) the other three.

    Two layouts are known beside plain tables:

    * ``orders_hot``/``deliveries_hot``: the rows of a few order ids that are kept apart
      from the others (:mod:`tiffin.sources.catalog`).  ``orders`` and ``deliveries`` are then the
      unions, and :meth:`by_order` joins each part with its own counterpart.
    * an ``orders`` source with the column ``MONTH``, its partition: jobs do not see
      the column, and :meth:`orders_in` prunes by it.
    """

    def __init__(self, customers: Source | None = None, restaurants: Source | None = None,
                 orders: Source | None = None, riders: Source | None = None,
                 deliveries: Source | None = None, orders_hot: Source | None = None,
                 deliveries_hot: Source | None = None) -> None:
        self._sources: dict[str, Source] = dict(
            customers=customers, restaurants=restaurants, orders=orders,
            riders=riders, deliveries=deliveries, orders_hot=orders_hot, deliveries_hot=deliveries_hot,
        )
        self._frames: dict[str, DataFrame] = {}
        #: Size checks of lookups made so far, by plan (see operators.broadcast).
        self.checked: dict[int, tuple[int, int]] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._frames:
            src = self._sources[name]
            if src is None:
                raise ValueError(f"table {name!r} was not provided")
            self._frames[name] = src if isinstance(src, DataFrame) else src()
        return self._frames[name]

    def _whole(self, name: str) -> DataFrame:
        main = self._get(name).drop(MONTH)
        return main.unionByName(self._get(f"{name}_hot")) if self._sources[f"{name}_hot"] is not None else main

    customers = property(lambda self: self._get("customers"))
    restaurants = property(lambda self: self._get("restaurants"))
    orders = property(lambda self: self._whole("orders"))
    riders = property(lambda self: self._get("riders"))
    deliveries = property(lambda self: self._whole("deliveries"))

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def by_order(self, job: Callable[[DataFrame, DataFrame], DataFrame], *ranges: DateRange) -> DataFrame:
        """``job(orders, deliveries)`` for a job that brings the two together
        on ``order_id``, with the orders of the date ranges (all without one): the union
        over the parts, which have no order id in common."""
        main = job(self._dated("orders", ranges), self._get("deliveries"))
        if self._sources["orders_hot"] is None:
            return main
        return main.unionByName(job(self._dated("orders_hot", ranges), self._get("deliveries_hot")))

    def orders_in(self, *ranges: DateRange) -> DataFrame:
        """Orders whose date is in one of the ranges.  Where orders are partitioned by
        month, the ranges also bound the month, so that other partitions are not listed."""
        main = self._dated("orders", ranges)
        return main.unionByName(self._dated("orders_hot", ranges)) if self._sources["orders_hot"] is not None else main

    def _dated(self, name: str, ranges: Sequence[DateRange]) -> DataFrame:
        orders = self._get(name)
        if not ranges:
            return orders.drop(MONTH)
        if MONTH in orders.columns:
            months = [(None if low is None else F.trunc(low, "MM"), high) for low, high in ranges]
            orders = orders.filter(_in_any(months, F.col(MONTH))).drop(MONTH)
        return orders.filter(_in_any(ranges, F.col("order_date")))


def _in_any(ranges: Sequence[DateRange], date: Column) -> Column:
    """Whether the date is in one of the ranges, each bounded on one side at least."""
    def inside(low: Column | None, high: Column | None) -> Column:
        bounds = [date >= low] if low is not None else []
        bounds += [date < high] if high is not None else []
        return reduce(and_, bounds)

    return reduce(or_, [inside(low, high) for low, high in ranges])


def conform(df: DataFrame, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Project ``df`` onto the declared columns of ``table``, in declared
    order, casting each to its declared type (a no-op when it already is).
    Times of day may be text, timestamps, ``TIME`` or numbers of seconds (see
    :func:`tiffin.functions.seconds_of_day`).

    Missing columns raise immediately, at plan time; extra columns but those of
    ``keep`` are dropped, so the Parquet scan only reads declared columns.
    """
    schema = SCHEMAS[table]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")

    def column(name: str, declared: DataType) -> F.Column:
        given = df.schema[name].dataType
        if given == declared:
            return F.col(name)
        if name in TIME_COLUMNS:
            return seconds_of_day(F.col(name), given, f"{table}.{name}").alias(name)
        return F.col(name).cast(declared).alias(name)

    extra = [c for c in keep if c in df.columns]
    return df.select(*[column(f.name, f.dataType) for f in schema.fields], *extra)


def stored_name(spark: SparkSession, root: str, name: str) -> str | None:
    """The name under ``root`` that spells ``name`` or ``name.parquet`` in any
    case (SQL names have none), found by listing the store; None if there is none.
    The exact spelling comes first; two others that differ in case alone are an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    listed = [status.getPath().getName() for status in store.listStatus(folder)]
    for wanted in (name, f"{name}.parquet"):
        found = [n for n in listed if n.lower() == wanted.lower()]
        if wanted in found or len(found) == 1:
            return wanted if wanted in found else found[0]
        if found:
            raise ValueError(f"{root} has several tables named {name}: {sorted(found)}")
    return None


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Read ``{root}/{table}`` (Parquet by default; ``{table}.parquet`` if
    that is what there is) for each of the five tables, in any spelling of upper and lower case.
    Spark lists the folder and reads the paths, so the root may be on any store that it can read."""
    def reader(name: str) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            stored = stored_name(spark, root, name) or name
            found = spark.read.format(fmt).load(os.path.join(root, stored))
            return conform(found, name, keep=[MONTH] if name == "orders" else [])

        return read

    return Tables(**{name: reader(name) for name in TABLE_NAMES})


def write_tables(
    tables: Tables,
    root: str,
    mode: str = "errorifexists",
    cluster_orders_by_date: bool = True,
    partition_orders_by_month: bool = False,
) -> None:
    """Write the five tables as Parquet under ``root/<table>``.

    With ``cluster_orders_by_date`` orders are range-partitioned and sorted
    by ``order_date`` before writing, so each file (and row group) covers a
    narrow date range.  The questions push their date bounds into the scan
    (``PushedFilters``), and Parquet's min/max statistics then skip whole
    files and row groups outside the range.  ``order_id`` breaks ties, so a
    date (or NULL) holding a third of all orders is spread over several
    write tasks instead of one.

    With ``partition_orders_by_month`` orders also have one folder per month
    (``MONTH``, the first day of the month).  Scans of a date range then list and open the
    folders of its months only (``PartitionFilters``), without reading a footer of the others.
    """
    for name, df in tables.as_dict().items():
        if name == "orders" and cluster_orders_by_date:
            df = df.repartitionByRange("order_date", "order_id").sortWithinPartitions(
                "order_date", "order_id"
            )
        writer = df.write
        if name == "orders" and partition_orders_by_month:
            writer = df.withColumn(MONTH, F.trunc("order_date", "MM")).write.partitionBy(MONTH)
        writer.mode(mode).parquet(os.path.join(root, name))


class Intermediates:
    """Tables written under the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``) and read back, until the context ends::

        with Intermediates(spark) as work:
            write_report(report(tables, work=work), out)

    Used where several jobs share an expensive intermediate: the lineage is
    cut (a lost executor re-reads files instead of recomputing the shuffle
    chain), and later scans get Parquet column pruning and pushdown.
    ``remove`` (called on leaving the context) deletes the folder; DataFrames over its
    tables can no longer be evaluated then.
    """

    def __init__(self, spark: SparkSession) -> None:
        from tiffin.session import ensure_checkpoint_dir

        self.spark = spark
        self.root = os.path.join(ensure_checkpoint_dir(spark), "tiffin", uuid.uuid4().hex)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.root, name)
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Intermediates:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()


def register_views(tables: Tables, prefix: str = "") -> list[str]:
    """Register the five tables as temporary views (``customers``,
    ``orders``, ...) for ad-hoc ``spark.sql`` next to the catalogue jobs."""
    names = []
    for name, df in tables.as_dict().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
