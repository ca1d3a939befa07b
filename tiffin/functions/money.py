"""Money sums that lose nothing, and exact decimal rounding.

Summing ``double`` amounts gives results that depend on the order rows are
added, i.e. on partitioning.  Amounts are therefore summed as decimals, in bins by
the size of their digits, and turned into ``double`` only at the end.  An amount stands
for the shortest decimal that reads back as the same double (what it prints as).

=============  ===============  =================================================
column         type             holds, of the finite amounts
=============  ===============  =================================================
``name``       DECIMAL(38,6)    below ``LARGE``: the digits down to ``10**-6``
``name_fine``  DECIMAL(38,24)   below ``FINE_BELOW``: what the sixth digit rounds off
``name_wide``  DECIMAL(38,0)    from ``LARGE`` on, below ``HUGE``
``name_odd``   DOUBLE           NaN, the infinities, and ``HUGE`` amounts and beyond
=============  ===============  =================================================

Every digit from ``10**-24`` up to ``HUGE`` is in one of the bins (doubles from
``FINE_BELOW`` on have none past the sixth), so the sums do not depend on the
order of the rows, and each bin has room for 10**12 rows.  A NaN makes the sum NaN
and an infinity makes it infinite, as ``SUM`` over ``FLOAT`` does; sums with an amount of ``HUGE``
or more have the usual rounding of doubles.  Percentages are rounded with
integer arithmetic, half away from zero, which is what ``ROUND(numeric, 2)`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of the everyday bin; most amounts have no more.
SCALE = 6
FINE_SCALE = 24
LARGE, HUGE = 1e18, 1e26
#: From here on doubles have no digits past the sixth decimal.
FINE_BELOW = 1e12

#: A sum is the column ``name`` and these beside it.
BINS = ("", "_fine", "_wide", "_odd")


def money_sums(amount: Column, name: str) -> dict[str, Column]:
    """The aggregates of ``SUM(amount)``, one for each bin (NULL if nothing
    falls in it).  All of them can be summed again."""
    size = F.abs(amount)
    everyday = size < F.lit(LARGE)  # false for NaN and the infinities
    rounded = amount.cast(f"decimal(38,{SCALE})")
    # whether six decimals are all there is: an integer of millionths below 2**53, divided
    # by a million, is the double nearest to that decimal
    millionths = F.rint(amount * F.lit(1e6))
    short = (F.abs(millionths) < F.lit(2.0**53)) & (millionths / F.lit(1e6) == amount)
    rest = (amount.cast(f"decimal(36,{FINE_SCALE})") - amount.cast(f"decimal(18,{SCALE})")).cast(f"decimal(38,{FINE_SCALE})")
    wide = ~everyday & (size < F.lit(HUGE))
    return {
        name: F.sum(F.when(everyday, rounded)),
        f"{name}_fine": F.sum(F.when(~short & (size < F.lit(FINE_BELOW)), rest)),
        f"{name}_wide": F.sum(F.when(wide, amount.cast("decimal(38,0)"))),
        f"{name}_odd": F.sum(F.when(~(size < F.lit(HUGE)), amount)),
    }


def sums_again(name: str) -> dict[str, Column]:
    """The bins of a money sum, added up once more."""
    return {name + b: F.sum(name + b) for b in BINS}


def money_value(name: str) -> Column:
    """The sum that ``money_sums`` left in its bins, as ``double`` (NULL
    when every amount is NULL).  The bins are added as decimals, with as many
    digits as a double of that size can have, so that only the result is rounded."""
    plain, fine, wide, odd = (F.col(name + b) for b in BINS)
    size = F.greatest(F.abs(plain).cast("double"), F.abs(wide).cast("double"))  # of those that are there

    def added(scale: int) -> Column:
        terms = [F.coalesce(c.cast(f"decimal(36,{scale})"), F.lit(0).cast(f"decimal(36,{scale})")) for c in (plain, fine, wide)]
        return (terms[0] + terms[1] + terms[2]).cast("double")

    total = (
        F.when(fine.isNull() & wide.isNull(), plain.cast("double"))
        .when(size < F.lit(1e11), added(FINE_SCALE))
        .when(size < F.lit(1e23), added(12))
        .when(size < F.lit(1e35), added(0))
        .otherwise(wide.cast("double") + F.coalesce(plain.cast("double"), F.lit(0.0)))
    )
    return F.when(odd.isNull(), total).otherwise(odd + F.coalesce(total, F.lit(0.0)))


def _int_div(x: Column, y: Column) -> Column:
    """Exact ``floor(x / y)`` for integral ``x >= 0`` and ``y > 0``: the
    remainder is removed first, so the decimal quotient is an exact integer."""
    exact_multiple = (x - F.pmod(x, y)).cast("decimal(38,0)")
    return (exact_multiple / y.cast("decimal(38,0)")).cast("bigint")


def rounded_ratio(num: Column, den: Column, multiplier: int = 1, digits: int = 2) -> Column:
    """``ROUND(num * multiplier / den, digits)`` for integral ``num``/``den``,
    computed exactly and rounded half away from zero, returned as ``double``.

    NULL when either side is NULL or ``den`` is 0.
    """
    scale = 10 ** digits
    a = num.cast("bigint") * F.lit(multiplier * scale)
    b = den.cast("bigint")
    # |a| / |b| rounded half up == floor((2|a| + |b|) / 2|b|)
    magnitude = _int_div(F.abs(a) * 2 + F.abs(b), F.abs(b) * 2)
    signed = F.when((a < 0) != (b < 0), -magnitude).otherwise(magnitude)
    return F.when(b != 0, signed.cast("double") / F.lit(float(scale)))
