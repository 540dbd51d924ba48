"""Date expressions. Locale-free: the weekend test uses day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystack.functions._util import col_of


def to_date_safe(c, fmt: str = "yyyy-M-d", slash_to_dash: bool = True) -> Column:
    """Text -> date; '/' is read as '-' first; unparsable text -> null."""
    s = col_of(c)
    if slash_to_dash:
        s = F.replace(s, F.lit("/"), F.lit("-"))
    return F.try_to_date(s, fmt)


def weekend_flag(c) -> Column:
    """True on Saturday and Sunday (Spark: Sunday = 1, Saturday = 7)."""
    return F.dayofweek(col_of(c)).isin(1, 7)


def quarter_label(c) -> Column:
    return F.concat(F.lit("Q"), F.quarter(col_of(c)).cast("string"))


def month_floor(c) -> Column:
    return F.trunc(col_of(c), "month")
