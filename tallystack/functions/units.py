"""Unit conversions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystack.functions._util import col_of


def f_to_c(c, digits: int = 2) -> Column:
    """Fahrenheit -> Celsius, rounded to ``digits``."""
    return F.round((col_of(c) - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0), digits)


def in_to_mm(c) -> Column:
    """Inches -> millimetres."""
    return col_of(c) * F.lit(25.4)
