"""Time-of-day expressions on integral seconds of the day.

A reference ``TIME`` value is stored as seconds since midnight (0..86399;
86400 stands for 24:00:00).  All helpers are built-in column expressions, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_DAY = 86400

# The text forms of a time of day.
TIME_TEXT = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*$"


def seconds_of_day(value: Column, kind: T.DataType, name: str = "time") -> Column:
    """A time of day as whole seconds, from a text ``HH:MM[:SS[.f]]``, a
    timestamp (its time of day), Spark's ``TIME`` type, or a number of seconds.

    24:00:00 is 86400.  NULL stays NULL.  Text that is no time of day, and a
    value with a fraction of a second (which whole seconds would lose), raise
    an error that names the column and the value.
    """
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        whole = F.floor(value).cast("bigint")
        return F.when(value.isNull() | (whole == value), whole).otherwise(_no_time(value, name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "HH:mm:ss.SSSSSS")
    else:
        text = value.cast("string")
    part = [F.regexp_extract(text, TIME_TEXT, i) for i in (1, 2, 3, 4)]
    hours, minutes, seconds = (F.coalesce(F.try_to_number(p, F.lit("99")).cast("bigint"), F.lit(0)) for p in part[:3])
    total = hours * 3600 + minutes * 60 + seconds
    valid = text.rlike(TIME_TEXT) & (minutes < 60) & (seconds < 60) & (total <= SECONDS_PER_DAY) & part[3].rlike("^0*$")
    return F.when(text.isNull() | valid, F.when(text.isNotNull(), total)).otherwise(_no_time(text, name))


def _no_time(value: Column, name: str) -> Column:
    message = F.concat(F.lit(f"{name}: not a time of day in whole seconds: "), value.cast("string"))
    return F.raise_error(message).cast("bigint")


def hour_of(seconds: Column) -> Column:
    """``EXTRACT(HOUR FROM t)``: 0..23, and 24 for 24:00:00."""
    return F.floor(seconds / F.lit(3600)).cast("bigint")


def slot_label(seconds: Column, hours: int = 2) -> Column:
    """Label of the ``hours``-wide slot of the day containing ``seconds``,
    e.g. ``'08:00 - 10:00'``; the last 2-hour slot is ``'22:00 - 00:00'``.

    NULL for a NULL time and for anything outside 00:00:00-23:59:59 (so
    24:00:00 gets no slot), like a CASE with no ELSE branch.  Integer
    division replaces the twelve ``BETWEEN`` branches of the original query.
    """
    if hours <= 0 or 24 % hours:
        raise ValueError("slot width must divide 24 hours")
    start = F.floor(hour_of(seconds) / F.lit(hours)).cast("bigint") * hours
    end = (start + hours) % 24
    label = F.format_string("%02d:00 - %02d:00", start, end)
    inside = (seconds >= 0) & (seconds < SECONDS_PER_DAY)
    return F.when(inside, label)


def time_difference(later: Column, earlier: Column, as_interval: bool = False) -> Column:
    """Raw ``later - earlier``, negative across midnight: seconds, or a
    day-time interval as SQL has it for ``time - time``."""
    if not as_interval:
        return later - earlier
    return F.make_dt_interval(secs=(later - earlier).cast("decimal(18,6)"))


def wrapped_seconds(later: Column, earlier: Column) -> Column:
    """``later - earlier``, plus one day when ``later < earlier`` (the
    delivery happened after midnight)."""
    raw = later - earlier
    return raw + F.when(later < earlier, F.lit(SECONDS_PER_DAY)).otherwise(F.lit(0))
