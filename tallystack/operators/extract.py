"""Upstream extracts: dense entity x day grid, cumulative columns, audience
and reach aggregates, per-entity counts and statistics."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_grid(events: DataFrame, key: str, ts: str, cond=None, start=None, end=None,
               day: str = "day", count_name: str = "n_hits", flag: str = "ch_in") -> DataFrame:
    """One row per (entity, calendar day) between ``start`` and ``end``
    (default: first and last event day), with the number of events meeting
    ``cond`` that day and a 0/1 flag. Days are generated per entity with
    ``sequence`` (no join against a day table); the counts join back on
    (entity, day), both sides hashed by entity."""
    ev = events.select(F.col(key), F.to_date(F.col(ts)).alias(day),
                       (cond if cond is not None else F.lit(True)).alias("_hit"))
    if start is None or end is None:
        lo, hi = ev.agg(F.min(day), F.max(day)).first()
        start, end = start or lo, end or hi
    if start is None or end is None:             # no events: an empty grid
        return (ev.select(key, day).limit(0).withColumn(count_name, F.lit(0).cast("long"))
                  .withColumn(flag, F.lit(0)))
    start, end = (_dt.date.fromisoformat(str(x)[:10]) for x in (start, end))
    days = F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))
    grid = ev.select(key).distinct().withColumn(day, F.explode(days))
    counts = ev.groupBy(key, day).agg(F.count_if(F.col("_hit")).alias(count_name))
    out = grid.join(counts, [key, day], "left")
    out = out.withColumn(count_name, F.coalesce(F.col(count_name), F.lit(0)))
    return out.withColumn(flag, F.when(F.col(count_name) > 0, 1).otherwise(0))


def cumulative(df: DataFrame, key: str, order, col: str, how: str = "sum",
               name: str | None = None) -> DataFrame:
    """Running sum / max / min / count per entity in ``order``. One row per
    (entity, day) keeps a window partition at most as long as the calendar."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.withColumn(name or f"cum_{how}_{col}", fn(F.col(col)).over(w))


def audience_mean(posts: DataFrame, users: DataFrame, key: str, user: str,
                  cols, names=None) -> DataFrame:
    """Mean of user attributes over the distinct users who posted about each
    entity. Distinct and mean are both aggregations (partial on the map side)."""
    names = names or [f"avg_{c}" for c in cols]
    pairs = posts.select(key, user).distinct()
    j = pairs.join(users.select(user, *cols), [user])
    return j.groupBy(key).agg(*[F.avg(c).alias(n) for c, n in zip(cols, names)])


def reach_daily(posts: DataFrame, users: DataFrame, key: str, day: str, user: str,
                col: str, name: str) -> DataFrame:
    """Sum of a user attribute over posts per (entity, day)."""
    j = posts.select(key, day, user).join(users.select(user, col), [user])
    return j.groupBy(key, day).agg(F.sum(col).alias(name))


def count_per(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def review_stats(df: DataFrame, key: str, mean_cols: dict, count_name: str,
                 sum_cols: dict) -> DataFrame:
    """Per entity: means ``{out: col}``, row count, sums ``{out: col}``."""
    aggs = [F.avg(c).alias(o) for o, c in mean_cols.items()]
    aggs.append(F.count(F.lit(1)).alias(count_name))
    aggs += [F.sum(c).alias(o) for o, c in sum_cols.items()]
    return df.groupBy(key).agg(*aggs)
