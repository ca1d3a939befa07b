"""Set membership with SQL's three-valued ``NOT IN`` semantics, scalably.

``x NOT IN (SELECT k FROM s)`` is TRUE when ``s`` is empty; otherwise it is
TRUE only if ``x`` is not NULL, ``s`` holds no NULL, and no ``k`` equals
``x``.  Spark plans SQL ``NOT IN`` as a null-aware anti join that broadcasts
the whole subquery result, which does not survive a large ``s``.  Here the
same rule is a plain (shuffled or broadcast, as the planner decides)
``left_anti`` join on the non-NULL keys plus two scalar subqueries over
``s`` (its row count and its NULL count), which Spark evaluates once and
inlines as literals into the final filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS, _NULLS, _KEY = "__s_rows", "__s_nulls", "__s_key"


def not_in(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Rows of ``left`` where ``left_col NOT IN (right.right_col)``.

    ``right`` is read twice: once for the scalar summary (a global
    aggregate, partial per task, so only one row per task is exchanged) and
    once for the distinct non-NULL keys the anti join probes.  The distinct
    runs as a partial aggregation before its shuffle, so a key repeated in a
    third of ``right`` arrives as one row per task, and the join's buffered
    side holds each key once.
    """
    keys = right.select(F.col(right_col).alias(_KEY))
    # Scalar subqueries over the same aggregate: Spark merges them into one.
    rows = keys.agg(F.count(F.lit(1)).alias(_ROWS)).scalar()
    nulls = keys.agg(F.count_if(F.col(_KEY).isNull()).alias(_NULLS)).scalar()
    present = keys.filter(F.col(_KEY).isNotNull()).distinct()
    survivors = left.join(present, left[left_col] == present[_KEY], "left_anti")
    keep = (rows == 0) | (F.col(left_col).isNotNull() & (nulls == 0))
    return survivors.filter(keep)
