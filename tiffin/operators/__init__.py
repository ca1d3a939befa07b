"""Reusable relational building blocks."""

from tiffin.operators.broadcast import broadcast_if_small, is_small
from tiffin.operators.lookup import rollup_through_lookup
from tiffin.operators.membership import not_in
from tiffin.operators.quality import (
    bitmaps_pay,
    drop_null,
    key_audit,
    length_audit,
    null_count,
    null_rows,
    reference_audit,
)
from tiffin.operators.ranking import keep_top_ranks, order_key

__all__ = [
    "bitmaps_pay", "broadcast_if_small", "drop_null", "is_small", "keep_top_ranks", "key_audit", "length_audit", "not_in", "null_count",
    "null_rows", "order_key", "reference_audit", "rollup_through_lookup",
]
