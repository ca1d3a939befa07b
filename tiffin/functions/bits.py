"""Doubles as integers of the same order, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit floating-point format.
FRACTION_BITS = 52
BIAS = 1023
LEAST_NORMAL = 2.0**-1022
INFINITY_BITS = 2047 << FRACTION_BITS


def order_bits(x: Column) -> Column:
    """A bigint that orders as the double does: the bits of its magnitude,
    negated for negative numbers.  Both zeros are 0; NaN follows infinity;
    NULL stays NULL.  Different numbers have different values.

    Exponent and fraction are worked out with powers of two, which doubles
    hold exactly; a logarithm only guesses the exponent, and is corrected.
    """
    size = F.abs(x)
    normal = (size >= F.lit(LEAST_NORMAL)) & (size < F.lit(float("inf")))
    safe = F.when(normal, size).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(safe))
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(safe < power, F.lit(-1)).when(safe >= power * 2, F.lit(1)).otherwise(F.lit(0))
    fraction = (safe * F.pow(F.lit(2.0), -exponent) - 1) * F.lit(2.0**FRACTION_BITS)
    bits = (exponent + BIAS) * F.lit(1 << FRACTION_BITS) + fraction.cast("bigint")
    # below the normal numbers the bits are the multiple of 2**-1074, reached in two exact steps
    tiny = F.when(size < F.lit(LEAST_NORMAL), size * F.lit(2.0**537) * F.lit(2.0**537)).otherwise(F.lit(0.0))
    found = (
        F.when(F.isnan(x), F.lit(INFINITY_BITS + 1))
        .when(size == F.lit(float("inf")), F.lit(INFINITY_BITS))
        .when(normal, bits)
        .otherwise(tiny.cast("bigint"))
    )
    return F.when(x.isNotNull(), F.when(x < 0, -found).otherwise(found))
