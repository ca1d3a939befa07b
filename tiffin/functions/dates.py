"""Date expressions written so that Catalyst can push them into the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: dt.date | str | None) -> Column:
    """The reporting date: ``CURRENT_DATE`` unless a date is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def years_before(as_of: dt.date | str | None, years: int = 1) -> Column:
    """``as_of - INTERVAL 'years' YEAR`` (Feb 29 maps to Feb 28).

    Constant-folded by Catalyst, so a ``>=`` comparison with it is pushed to
    Parquet as a literal bound.
    """
    return F.add_months(as_of_date(as_of), -12 * years)


def in_year(date_col: Column, year: int) -> Column:
    """``EXTRACT(YEAR FROM d) = year`` as a half-open date range.

    ``year(d) = y`` only pushes ``IsNotNull`` to Parquet; the range pushes
    ``>=`` and ``<`` and lets row groups be skipped by their statistics.
    """
    return (date_col >= F.lit(dt.date(year, 1, 1))) & (date_col < F.lit(dt.date(year + 1, 1, 1)))


def year_range(year: int) -> tuple[Column, Column]:
    """First day of the year, and of the next."""
    return F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year + 1, 1, 1))


def in_any_year(date_col: Column, years: list[int]) -> Column:
    """OR of :func:`in_year` ranges (pushed down as one ``Or`` filter)."""
    cond = None
    for y in sorted(set(years)):
        c = in_year(date_col, y)
        cond = c if cond is None else (cond | c)
    return cond


def month_text(date_col: Column) -> Column:
    """``TO_CHAR(d, 'mm-yy')``: two-digit month, dash, two-digit year.

    (In Spark patterns ``mm`` means minutes; months are ``MM``.)
    """
    return F.date_format(date_col, "MM-yy")
