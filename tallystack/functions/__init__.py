"""Column-level building blocks (native Spark expressions, no UDFs)."""

from tallystack.functions.text import strip_first, strip_all, open_hours, null_if_text
from tallystack.functions.calendar import to_date_safe, weekend_flag, quarter_label, month_floor
from tallystack.functions.units import f_to_c, in_to_mm
from tallystack.functions.hashing import hash_uniform
from tallystack.functions.strict import strict_agg, safe_ratio

__all__ = [
    "strip_first", "strip_all", "open_hours", "null_if_text",
    "to_date_safe", "weekend_flag", "quarter_label", "month_floor",
    "f_to_c", "in_to_mm", "hash_uniform", "strict_agg", "safe_ratio",
]
