"""The five tables as catalog tables, with orders and deliveries co-bucketed.

Q5, Q9, Q10, Q11 and Q13 all bring deliveries and orders together on
``order_id``; at 100 TB that shuffle of both tables dominates the workload.
Written once with ``bucketBy(n, "order_id")`` into the same number of
buckets, both tables arrive already partitioned by the join key: the per-order
delivery counts, and the joins on ``order_id``, then read bucket ``i`` of
both sides in one task with no exchange.  Rows are repartitioned by the key
first, so a table has one file per bucket, sorted by the key.  Spark still
sorts each bucket before a sort-merge join unless the session sets
``spark.sql.legacy.bucketedTableScan.outputOrdering``, which lets it use the
order of single-file buckets.

Buckets cannot be split when they are read.  Order ids that fill more than
``HOT_BUCKETS`` average buckets in either table (NULL may be one of them) are therefore kept out:
their orders and deliveries go to the plain tables ``orders_hot`` and ``deliveries_hot``
beside the bucketed ones.  An order id is in one part of both tables, so a join on it is
the union of two joins (``Tables.by_order``): the bucketed one without an exchange, and one of the few
hot ids, whose shuffle adaptive execution splits (or whose few orders it broadcasts).
At most ``buckets / HOT_BUCKETS`` ids of a table can be hot, which bounds their list.  Bucketing
needs a metastore (``saveAsTable``) and a warehouse folder that all executors share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.sources.tables import TABLE_NAMES, Tables, conform

BUCKETED_BY_ORDER = ("orders", "deliveries")

#: Average buckets that one key may fill before bucketing hurts more than it saves.
HOT_BUCKETS = 2
#: Rows that are no trouble in one task, whatever their share.
HOT_ROWS = 1000


def hot_ids(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The keys with more rows than HOT_BUCKETS average buckets, at least
    ``HOT_ROWS`` (keys are counted map-side first, so a hot one does not hurt here)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return counts.where(F.col("n") > F.greatest(rows * HOT_BUCKETS / buckets, F.lit(HOT_ROWS))).select(key)


def write_catalog_tables(
    tables: Tables,
    database: str,
    buckets: int,
    mode: str = "overwrite",
) -> list[str]:
    """Save the five tables as ``database.<table>``; orders and deliveries
    bucketed and sorted by ``order_id`` into ``buckets`` buckets of one file
    each, their hot ids apart as ``database.<table>_hot``.  Returns the hot ids.

    Pick ``buckets`` so one bucket of deliveries is a few hundred MB (for
    100 TB of deliveries: tens of thousands); both tables must use the same
    number for the joins to skip the shuffle.
    """
    spark = tables.orders.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    frames = tables.as_dict()
    key = "order_id"
    ids = reduce(DataFrame.union, [hot_ids(frames[name], key, buckets) for name in BUCKETED_BY_ORDER]).distinct()
    found = [row[0] for row in ids.collect()]  # at most buckets / HOT_BUCKETS of each table
    is_hot = F.when(F.col(key).isNull(), F.lit(None in found)).otherwise(F.col(key).isin([i for i in found if i is not None]))
    for name, df in frames.items():
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}_hot")
        writer = df.write
        if name in BUCKETED_BY_ORDER:
            if found:
                df.where(is_hot).write.mode(mode).format("parquet").saveAsTable(f"{database}.{name}_hot")
            rest = df.where(~is_hot) if found else df
            writer = rest.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        writer.mode(mode).format("parquet").saveAsTable(f"{database}.{name}")
    return found


def read_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """``database.<table>`` for the five tables, lazily, conformed to the
    declared schemas (without casts when the types already match, so the
    bucketing stays visible to the planner), with the hot parts if there are any."""

    def reader(name: str, declared: str):
        return lambda: conform(spark.table(f"{database}.{name}"), declared)

    hot = {f"{n}_hot": n for n in BUCKETED_BY_ORDER if spark.catalog.tableExists(f"{database}.{n}_hot")}
    return Tables(**{name: reader(name, declared) for name, declared in ({n: n for n in TABLE_NAMES} | hot).items()})
