"""Rank filters ("top k with ties") and full rankings over grouped results.

Ranks depend on the distinct values of a group alone, so rows are first
counted per (group, value), map-side before any shuffle, the *values* are
ranked, and the ranks are joined back to the rows.  A value that a third
of all rows share is one row while it is ranked; its ties meet again only in the
join, whose large side Spark splits.

* ``k`` up to ``MAX_TOP``: ``row_number <= k`` over the values is recognised by
  Catalyst, which keeps at most k values per group and task before the shuffle.
* a full ranking (``k=None``, or a larger k): the values of a group may be as
  many as its rows, so they are ranked through a histogram of their leading bits.
  A value becomes a 64-bit integer of the same order (``order_bits``), read as three
  digits of at most 22 bits.  Its rank is its place among the values with the same two
  leading digits, plus the sizes of the earlier second digits under the same first one,
  plus those of the earlier first digits.  No window thus sorts more than 2**22 rows,
  however many values a group has and however close they lie; there is no
  sample, no bound to choose, and no job while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tiffin.functions.bits import order_bits

METHODS = ("dense", "rank")

#: Above this Catalyst adds no limit per task (its own default threshold).
MAX_TOP = 1000

#: Bits of the two lower digits of a value; the first digit has the other 22.
DIGIT_BITS = 21

#: NULL sorts as the largest value.
_NULL_BITS = (1 << 63) - 1

_VALUES = "__rank_rows"


def order_key(col: str, descending: bool = True, nulls: str = "sql") -> Column:
    """Sort key; ``nulls='sql'`` puts NULLs first when descending and last
    when ascending (NULL sorts as the largest value), the PostgreSQL default.
    Spark's own default is the opposite; ``'first'``/``'last'`` force it."""
    c = F.col(col)
    first = (descending if nulls == "sql" else nulls == "first")
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def keep_top_ranks(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: str,
    k: int | None,
    method: str = "dense",
    rank_col: str = "rank1",
    descending: bool = True,
) -> DataFrame:
    """Add ``rank_col`` (bigint) ranking rows within ``partition_by`` by the
    numeric column ``order_by`` and keep ranks ``<= k`` (all rows when ``k``
    is None)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    values = df.groupBy(*partition_by, order_by).agg(F.count(F.lit(1)).alias(_VALUES))
    if k is None or k > MAX_TOP:
        ranked = ranked_by_radix(values, partition_by, order_by, method, rank_col, descending)
    else:
        ranked = ranked_top(values, partition_by, order_by, int(k), method, rank_col, descending)
    if k is not None:
        ranked = ranked.filter(F.col(rank_col) <= F.lit(int(k)))
    keys = [*partition_by, order_by]
    ranks = ranked.select(*[F.col(c).alias(f"__rank_{i}") for i, c in enumerate(keys)], rank_col)
    # NULL is a group and a value of its own, so keys are matched null-safely.
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__rank_{i}")) for i, c in enumerate(keys)])
    return df.join(ranks, same).select(*df.columns, rank_col)


def ranked_top(
    values: DataFrame, partition_by: Sequence[str], order_by: str, k: int, method: str, rank_col: str, descending: bool
) -> DataFrame:
    """Ranks of the first k values of each group."""
    window = Window.partitionBy(*partition_by).orderBy(order_key(order_by, descending))
    top = values.withColumn("__place", F.row_number().over(window)).filter(F.col("__place") <= F.lit(k))
    if method == "dense":
        return top.withColumn(rank_col, F.col("__place").cast("bigint"))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn(rank_col, F.coalesce(F.sum(_VALUES).over(before), F.lit(0)) + 1)


def ranked_by_radix(
    values: DataFrame, partition_by: Sequence[str], order_by: str, method: str, rank_col: str, descending: bool
) -> DataFrame:
    """Ranks of all values of each group: a value's place among those with the
    same leading bits, plus the sizes of the histogram's earlier buckets."""
    bits = F.coalesce(order_bits(F.col(order_by).cast("double")), F.lit(_NULL_BITS))
    place = -bits if descending else bits
    counted = F.lit(1) if method == "dense" else F.col(_VALUES)
    # one column for the group: a struct is never NULL, so joins on it keep the partitioning
    group = F.struct(*partition_by) if partition_by else F.lit(0)
    placed = values.withColumns({"__group": group, "__fine": F.shiftright(place, DIGIT_BITS), "__counted": counted})

    def before(window: WindowSpec, column: str) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    own = Window.partitionBy("__group", "__fine").orderBy(order_key(order_by, descending))
    local = placed.withColumn("__local", before(own, "__counted"))

    fine = placed.groupBy("__group", "__fine").agg(F.sum("__counted").alias("__size"))
    fine = fine.withColumn("__coarse", F.shiftright("__fine", DIGIT_BITS))
    coarse = fine.groupBy("__group", "__coarse").agg(F.sum("__size").alias("__size"))
    earlier = before(Window.partitionBy("__group").orderBy("__coarse"), "__size")
    coarse = coarse.select("__group", "__coarse", earlier.alias("__earlier"))
    inside = before(Window.partitionBy("__group", "__coarse").orderBy("__fine"), "__size")
    fine = fine.withColumn("__inside", inside).join(coarse, ["__group", "__coarse"])
    offsets = fine.select("__group", "__fine", (F.col("__earlier") + F.col("__inside")).alias("__offset"))
    rank = (F.col("__offset") + F.col("__local") + 1).cast("bigint")
    return local.join(offsets, ["__group", "__fine"]).withColumn(rank_col, rank).select(*values.columns, rank_col)
