"""Missing-value semantics of the reference: an aggregate over a group that
contains a missing input is itself missing (no silent skipping)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystack.functions._util import col_of


def strict_agg(fn, c, window=None) -> Column:
    """``fn(c)`` if no input in the group (or frame) is null, else null."""
    c = col_of(c)
    cnt, tot, val = F.count(c), F.count(F.lit(1)), fn(c)
    if window is not None:
        cnt, tot, val = cnt.over(window), tot.over(window), val.over(window)
    return F.when(cnt == tot, val)


def safe_ratio(a, b) -> Column:
    """a / b with division by zero -> null (ANSI-safe)."""
    return F.try_divide(col_of(a), col_of(b))
