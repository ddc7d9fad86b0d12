"""Column expressions on numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves of 26 bits, so that their products are exact.
_SPLITTER = float(2**27 + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * _SPLITTER
    high = big - (big - x)
    return high, x - high


def round_half_even(x: Column, digits: int) -> Column:
    """Round the exact binary value of a non-negative double, as Python's round does.

    x * 10^digits may be rounded onto a tie that the exact product is not on, so the error of the
    product decides there.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    x_high, x_low = _halves(x)
    s_high, s_low = _halves(scale)
    error = ((x_high * s_high - product) + x_high * s_low + x_low * s_high) + x_low * s_low
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / scale
