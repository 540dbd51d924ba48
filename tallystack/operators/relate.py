"""Equi-joins with key renaming and clash suffixes; the star assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.session import bounded_broadcast


def join_on(a: DataFrame, b: DataFrame, keys, how: str = "inner",
            suffixes=("_x", "_y"), broadcast_max_rows: int | None = None) -> DataFrame:
    """Join on equal keys. ``keys`` is a list of shared names or a dict
    ``{left_name: right_name}`` (the left name is kept). Non-key columns that
    exist on both sides get ``suffixes`` (Spark would otherwise keep two
    columns of one name). With ``broadcast_max_rows`` the right side is
    broadcast only if its row count is checked to be within that bound."""
    if isinstance(keys, dict):
        b = b.withColumnsRenamed({r: l for l, r in keys.items() if l != r})
        keys = list(keys)
    elif isinstance(keys, str):
        keys = [keys]
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    if clash:
        a = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        b = b.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if broadcast_max_rows is not None:
        b = bounded_broadcast(b, broadcast_max_rows)
    return a.join(b, keys, how)


def outer_chain(tables, keys) -> DataFrame:
    """Full outer joins of several tables on the same keys (``using`` join:
    the key columns are coalesced)."""
    return reduce(lambda x, y: x.join(y, keys, "full_outer"), tables)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def assemble(dim: DataFrame, key: str, facts: DataFrame, day: str,
             dim_left=(), facts_inner_key: str | None = None,
             daily_left=(), entity_left=(), parity: bool = False,
             broadcast_max_rows: int | None = None) -> DataFrame:
    """Dimension -> left joins of per-entity tables -> inner join of the daily
    facts -> left joins of per-(entity, day) tables -> left joins of
    per-entity tables.

    Default: every per-(entity, day) table must already be one row per key
    (aggregate it first), so nothing multiplies. ``parity=True`` reproduces
    the reference's full-row de-duplication after the daily joins, for
    inputs that repeat keys."""
    out = dim
    for t in dim_left:
        out = join_on(out, t, [key], "left", broadcast_max_rows=broadcast_max_rows)
    out = join_on(out, facts, {key: facts_inner_key or key}, "inner")
    for t in daily_left:
        out = join_on(out, t, [key, day], "left")
        if parity:
            out = out.dropDuplicates()
    for t in entity_left:
        out = join_on(out, t, [key], "left", broadcast_max_rows=broadcast_max_rows)
    return out


def bind_cols(left: DataFrame, right: DataFrame, position: str = "position", suffixes=("_x", "_y")) -> DataFrame:
    """Columns of two tables side by side, row for row by their ``position``
    (see ``sources.io.with_file_position``), which must be 1..n in both: an
    equi-join on a unique key, so no key is hot. Tables of different length
    raise, as a positional bind must not drop or recycle rows. Column names
    that clash take the suffixes."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows cannot be bound by position")
    return join_on(left, right, [position], "inner", suffixes=suffixes)
