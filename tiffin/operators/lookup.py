"""Aggregate facts to groups defined through a lookup (dimension) table.

"Revenue per city" when the city is a column of restaurants: the facts
(orders) must meet the lookup on its key before they can be grouped.  Two
exact plans, chosen by the lookup's *checked* number of rows and bytes:

* small lookup -- broadcast it and join first: the facts are never
  shuffled; only the partial aggregates of the final groups are.
* large lookup -- aggregate the facts per join key first (map-side partial
  aggregation, shuffled on the key), shuffle-join the lookup on that same
  partitioning, then re-aggregate to the final groups.  A join key holding
  a third of all facts becomes one partial row per task.

Measures must be re-aggregatable by summing their partials (COUNT and SUM
are), which is what makes the second plan exact, NULL sums included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.operators.broadcast import is_small

DEFAULT_LOOKUP_ROWS = 500_000


def rollup_through_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    group_by: Sequence[str],
    measures: Mapping[str, Column],
    max_broadcast_rows: int = DEFAULT_LOOKUP_ROWS,
    memo: dict[int, tuple[int, int]] | None = None,
) -> DataFrame:
    """``facts JOIN lookup USING (key) GROUP BY group_by`` with ``measures``
    (COUNT/SUM column expressions over fact columns, keyed by output name).

    ``group_by`` may mix lookup columns and fact columns; ``lookup`` should
    be projected to ``key`` plus the columns it contributes.
    """
    if is_small(lookup, max_broadcast_rows, memo=memo):
        joined = facts.join(F.broadcast(lookup), key)
        return joined.groupBy(*group_by).agg(*[expr.alias(name) for name, expr in measures.items()])
    fact_groups = [c for c in group_by if c not in lookup.columns]
    partial = facts.groupBy(key, *fact_groups).agg(*[expr.alias(name) for name, expr in measures.items()])
    return (
        partial.join(lookup, key)
        .groupBy(*group_by)
        .agg(*[F.sum(name).alias(name) for name in measures])
    )
