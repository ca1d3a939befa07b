"""Data-quality jobs: NULL profiles, clean-up, key/reference/length audits.

Audit reports share one shape: ``constraint_name, table_name, column_name,
violations`` (bigint), one row per declared constraint, so several audits can
be combined with ``unionByName``.  Each audit is one aggregation; keys are
pre-aggregated map-side before any shuffle, so a key repeated in a third of
all rows costs one partial-aggregate row per task, not a hot reducer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def null_count(df: DataFrame, cols: Sequence[str], alias: str = "null_count") -> DataFrame:
    """One row: how many rows have a NULL in any of ``cols``."""
    return df.agg(F.count_if(any_null(cols)).alias(alias))


def null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows having a NULL in any of ``cols``."""
    return df.filter(any_null(cols))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``DELETE FROM t WHERE c1 IS NULL OR c2 IS NULL ...`` as a new table:
    the rows that would survive the delete (write them out to replace ``t``)."""
    return df.dropna(how="any", subset=list(cols))


def _report(df_one_row: DataFrame, constraint: str, table: str, column: str) -> DataFrame:
    return df_one_row.select(
        F.lit(constraint).alias("constraint_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"),
    )


#: Bits and bytes of one of Spark's bitmaps.
BITMAP_BITS, BITMAP_BYTES = 32768, 4096

#: Bytes that a key costs when it is shuffled with its count.
KEY_BYTES = 8

#: Least share of distinct keys, by a sketch that errs by a twentieth.
UNIQUE_SHARE = 0.9

#: Classes of bitmaps that are told apart when keys are looked up again.
CLASSES = 1024


def bitmaps_pay(keyed: Sequence[tuple[DataFrame, str]]) -> list[bool]:
    """For each (table, key column) whether bitmaps are smaller than the keys:
    integers that lie close together in the files, as serial numbers do, and seldom
    repeat (ranges with repeats have to move their keys as well).  One job for all tables, in
    which every task sends sketches of its keys and of the bitmaps that it would fill."""
    def sizes(df: DataFrame, key: str) -> DataFrame:
        if not isinstance(df.schema[key].dataType, T.IntegralType):
            return df.sparkSession.range(1).select(F.lit(False).alias("pay"))
        read = df.select(F.col(key).alias("k"), F.spark_partition_id().alias("task"))
        touched = F.approx_count_distinct(F.struct("task", F.bitmap_bucket_number("k")))
        distinct = F.approx_count_distinct("k") >= F.count("k") * UNIQUE_SHARE
        return read.agg(((touched * BITMAP_BYTES < F.count("k") * KEY_BYTES) & distinct).alias("pay"))

    each = [sizes(df, key).select(F.lit(i).alias("i"), "pay") for i, (df, key) in enumerate(keyed)]
    found = dict(tuple(r) for r in reduce(DataFrame.union, each).collect())
    return [found[i] for i in range(len(keyed))]


def key_audit(df: DataFrame, key: str, table: str, constraint: str | None = None, bitmaps: bool = False) -> DataFrame:
    """Primary-key audit: number of key values occurring more than once,
    plus the number of rows whose key is NULL.

    With ``bitmaps`` (integer keys, see :func:`bitmaps_pay`) each key is one bit: per range of
    ``BITMAP_BITS`` integers the rows are counted and their bits set, map-side, and only if a
    range has more rows than bits are keys moved: those of ranges of the same class."""
    if not bitmaps:
        per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        violations = per_key.agg(
            (
                F.count_if(F.col("k").isNotNull() & (F.col("n") > 1))
                + F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0))
            ).alias("violations")
        )
        return _report(violations, constraint or f"{table}_pkey", table, key)
    number = F.bitmap_bucket_number(F.col(key))
    filled = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))))
    ranges = df.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n"), filled.alias("bits"))
    repeating = F.col("range").isNotNull() & (F.col("n") > F.col("bits"))
    summary = ranges.agg(
        F.collect_set(F.when(repeating, F.pmod("range", F.lit(CLASSES)))).alias("classes"),
        F.sum(F.when(F.col("range").isNull(), F.col("n"))).alias("nulls"),
    )
    found = summary.select(F.struct("classes", "nulls")).scalar()
    suspects = df.where((F.size(found["classes"]) > 0) & F.array_contains(found["classes"], F.pmod(number, F.lit(CLASSES))))
    per_key = suspects.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    violations = per_key.agg(F.count_if(F.col("n") > 1).alias("repeated"))
    violations = violations.select((F.col("repeated") + F.coalesce(found["nulls"], F.lit(0))).alias("violations"))
    return _report(violations, constraint or f"{table}_pkey", table, key)


def reference_audit(
    child: DataFrame,
    child_key: str,
    parent: DataFrame,
    parent_key: str,
    constraint: str,
    child_table: str,
) -> DataFrame:
    """Foreign-key audit: child rows whose non-NULL reference has no parent
    row (a NULL reference is allowed, as in SQL)."""
    refs = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # no DISTINCT: an anti join ignores repeated parents, and the keys are unique anyway
    parents = parent.select(F.col(parent_key).alias("k"))
    dangling = refs.join(parents, "k", "left_anti")
    return _report(dangling.agg(F.sum("n").alias("violations")), constraint, child_table, child_key)


def length_audit(df: DataFrame, table: str, limits: Sequence[tuple[str, int]]) -> DataFrame:
    """``VARCHAR(n)`` audit: per column, rows whose text is longer than n
    characters.  One scan of ``df`` for all its columns."""
    counts = df.agg(
        *[F.count_if(F.length(F.col(c)) > F.lit(n)).alias(f"v{i}") for i, (c, n) in enumerate(limits)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"varchar({n})").alias("constraint_name"),
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col(f"v{i}").cast("bigint").alias("violations"),
            )
            for i, (c, n) in enumerate(limits)
        ]
    )
    return counts.select(F.inline(rows))
