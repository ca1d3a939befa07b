"""Broadcast a join side only after proving it is small.

Spark's own size check uses *estimated* sizes: for a filtered dimension
(``customers WHERE customer_name = ?``) the estimate is the whole table, so a
join against a handful of rows is planned as a shuffle of the large side.
Adaptive execution can switch to a broadcast only after both shuffles have
been written.  ``broadcast_if_small`` checks the real number of rows and bytes first and
adds the broadcast hint only when both bounds hold; otherwise the DataFrame is
returned unchanged and the planner keeps its shuffle join.

The check is a plain global aggregate: every task counts its rows and adds up
their lengths and sends one partial row, so nothing else moves, whatever
the size.  (``limit(n + 1).count()`` would look cheaper but gathers up to
``n + 1`` rows from *every* partition into a single task -- exactly wrong for
the large lookups the check exists to reject.)  ``memo`` keeps the outcome by
plan, so a lookup that several questions share is checked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_ROWS = 200_000
DEFAULT_MAX_BYTES = 64 << 20


def measured(df: DataFrame, memo: dict[int, tuple[int, int]] | None = None) -> tuple[int, int]:
    """Rows and bytes of ``df`` (text and binary by length, other columns 8
    bytes), from one global aggregate."""
    key = df.semanticHash()
    if memo is not None and key in memo:
        return memo[key]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lengths = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    rows, *sizes = df.agg(F.count(F.lit(1)), *lengths).first()
    found = rows, sum(sizes) + 8 * rows * len(df.columns)
    if memo is not None:
        memo[key] = found
    return found


def is_small(
    df: DataFrame,
    max_rows: int = DEFAULT_MAX_ROWS,
    max_bytes: int = DEFAULT_MAX_BYTES,
    memo: dict[int, tuple[int, int]] | None = None,
) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes."""
    rows, size = measured(df, memo)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = DEFAULT_MAX_ROWS,
    max_bytes: int = DEFAULT_MAX_BYTES,
    memo: dict[int, tuple[int, int]] | None = None,
) -> DataFrame:
    """``broadcast(df)`` when it is small by both measures, else ``df``."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes, memo) else df
