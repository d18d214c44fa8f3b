"""Rounding of binary fractions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = float(1 << 52)  # doubles from here on have no fraction


def round_exact(number: Column, digits: int) -> Column:
    """Nearest value with ``digits`` decimals, judged by the exact binary value.

    A true tie goes to the even digit; 33.325, whose double lies just above,
    gives 33.33. Spark's own rounding judges the decimal text instead.
    """
    x = number.cast("double")
    scale = float(10**digits)
    scaled = x * scale
    low = F.floor(scaled)
    # x in two halves, so that twice the scaled value minus an odd number is exact.
    head = x.cast("float").cast("double")
    above = (head * (2 * scale) - (low * 2 + 1)) + (x - head) * (2 * scale)
    tie = F.when(above > 0, low + 1).when(above < 0, low).otherwise(
        low + F.abs(low % 2)
    )
    near = F.abs(scaled - low - 0.5) < 1e-3
    rounded = F.when(near, tie.cast("double")).otherwise(F.rint(scaled)) / scale
    return F.when(F.abs(scaled) < _WHOLE, rounded).otherwise(x)
