"""Text clean-up expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystack.functions._util import col_of


def strip_first(c, token: str) -> Column:
    """Remove only the first occurrence of ``token`` (literal text)."""
    return F.regexp_replace(col_of(c), "(?s)^(.*?)" + re.escape(token), "$1")


def strip_first_seq(c, tokens) -> Column:
    """Apply ``strip_first`` once per token, in order (a token may repeat)."""
    out = col_of(c)
    for t in tokens:
        out = strip_first(out, t)
    return out


def strip_all(c, token: str) -> Column:
    """Remove every occurrence of ``token`` (literal text)."""
    return F.replace(col_of(c), F.lit(token), F.lit(""))


def null_if_text(c, marker: str = "NULL") -> Column:
    """The text marker becomes SQL NULL."""
    return F.nullif(col_of(c), F.lit(marker))


def _clock_minutes(piece: Column) -> Column:
    """'H:M[:anything]' -> minutes after midnight; only the first two
    ':'-pieces count. 24:00 is allowed as end of day. Anything else -> null."""
    hm = F.split(piece, ":")
    h = F.try_element_at(hm, F.lit(1)).try_cast("int")
    m = F.try_element_at(hm, F.lit(2)).try_cast("int")
    ok = (h.between(0, 23) & m.between(0, 59)) | ((h == 24) & (m == 0))
    return F.when(ok, h * 60 + m)


def open_minutes(c):
    """(start, end) minutes after midnight from 'H:M-H:M' text."""
    parts = F.split(col_of(c), "-")
    return (_clock_minutes(F.try_element_at(parts, F.lit(1))),
            _clock_minutes(F.try_element_at(parts, F.lit(2))))


def hours_between(start, end) -> Column:
    """Hours from start to end minutes: equal -> 24, end before start ->
    crosses midnight."""
    start, end = col_of(start), col_of(end)
    diff = (F.when(start == end, F.lit(1440))
             .when(end < start, end + 1440 - start)
             .otherwise(end - start))
    return (diff / F.lit(60.0)).cast("double")


def open_hours(c) -> Column:
    """Opening-hours text 'H:M-H:M' -> hours open (double).

    Equal start and end means open 24 hours; an end before the start crosses
    midnight; unparsable text (e.g. 'none', missing minutes) gives null.
    """
    start, end = open_minutes(c)
    return hours_between(start, end)
