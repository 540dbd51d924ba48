"""Rolling and calendar features, sentiment counts and shares."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystack.functions import calendar as C
from tallystack.functions.strict import strict_agg
from tallystack.session import bounded_broadcast, stored

#: rows that one task of a sort over all rows should hold
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """Tasks that sort about ``TASK_ROWS`` rows each, at least the session's."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))


def rolling_rows(df: DataFrame, key: str, order, col: str, before: int = 14,
                 strict: bool = True, name: str | None = None) -> DataFrame:
    """Sum of this row and ``before`` rows before it per entity; partial at
    the start. ``strict``: a missing value in the frame gives missing.
    ``order`` should make the order total (add an id when a day repeats)."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, 0)
    val = strict_agg(F.sum, col, w) if strict else F.sum(col).over(w)
    return df.withColumn(name or f"rolling_{col}", val)


def rolling_rows_segmented(df: DataFrame, key: str, day: str, tiebreaks, col: str,
                           before: int = 14, strict: bool = True, name: str | None = None,
                           segment_rows: int = 100_000) -> DataFrame:
    """``rolling_rows`` ordered by (day, *tiebreaks) within an integer key,
    safe for a key that holds a large share of all rows: each row's position
    inside its key comes from the two-phase global order of
    (key, day, *tiebreaks) minus the key's first position (an aggregation);
    rows are cut into segments of ``segment_rows`` positions, and the
    ``before`` rows preceding a segment are copied into it as a halo, so
    every window partition holds at most ``segment_rows + before`` rows. The
    number of tasks follows the rows (``tasks_for``), so that what one sorts
    does not grow with the table.
    ``key`` must be a non-negative integer below 2**31, ``day`` a date; rows
    without a key form a group of their own, rows without a day end theirs."""
    from tallystack.operators.ordered import ordered_prefix
    name, tasks = name or f"rolling_{col}", tasks_for(df)
    ties = [tiebreaks] if isinstance(tiebreaks, str) else list(tiebreaks)
    score = (F.coalesce(F.col(key).cast("double"), F.lit(-1.0)) * float(1 << 21)
             + F.coalesce(F.unix_date(F.col(day).cast("date")), F.lit((1 << 20) - 1)) + (1 << 20))
    o = ordered_prefix(df.withColumn("_rs", score), "_rs", ties, descending=False, rank_col="_g",
                       total_col=None, n_buckets=tasks).drop("_rs")
    first = bounded_broadcast(stored(o.groupBy(key).agg(F.min("_g").alias("_g0")), "first"), 1_000_000)
    first = first.withColumnRenamed(key, "_k0")
    o = o.join(first, F.col(key).eqNullSafe(F.col("_k0"))).withColumn("_pos", F.col("_g") - F.col("_g0")).drop("_g", "_g0", "_k0")
    seg = F.floor(F.col("_pos") / segment_rows)
    last = F.col("_pos") % segment_rows >= segment_rows - before          # these rows precede the next segment too
    both = (o.withColumn("_seg", F.explode(F.when(last, F.array(seg, seg + 1)).otherwise(F.array(seg))))
             .withColumn("_halo", F.col("_seg") != seg).repartition(tasks, key, "_seg"))
    w = Window.partitionBy(key, "_seg").orderBy("_pos").rowsBetween(-before, 0)
    val = strict_agg(F.sum, col, w) if strict else F.sum(col).over(w)
    return both.withColumn(name, val).filter(~F.col("_halo")).drop("_seg", "_halo")


def rolling_days(df: DataFrame, key: str, date: str, col: str, days: int = 14,
                 strict: bool = True, name: str | None = None) -> DataFrame:
    """Sum over the calendar window [date - days, date] per entity."""
    w = (Window.partitionBy(key)
         .orderBy(F.unix_date(F.col(date).cast("date")))
         .rangeBetween(-days, 0))
    val = strict_agg(F.sum, col, w) if strict else F.sum(col).over(w)
    return df.withColumn(name or f"rolling_{col}", val)


def rolling_rejoin(df: DataFrame, key: str, date: str, order, col: str, before: int = 14,
                   strict: bool = True, name: str | None = None, segment_rows: int | None = None) -> DataFrame:
    """The reference computes the row-wise rolling sum and joins it back on
    (entity, day); with k rows on one (entity, day) that join repeats each of
    them k times (k*k rows). Emitting those pairs is avoided: each input row
    is returned once with ``rejoin_copies`` (= k, how often the reference
    repeats it) and the smallest and largest rolling value of its day, which
    bound the k joined values. The per-day summary is an aggregation joined
    back on (entity, day). With ``segment_rows`` the rolling sum itself uses
    the hot-key-safe segmented form (``order`` = [day, *integer-free
    tiebreaks] and an integer key)."""
    name = name or f"rolling_{col}"
    order = [order] if isinstance(order, str) else list(order)
    if segment_rows:
        r = rolling_rows_segmented(df, key, order[0], order[1:], col, before, strict, name, segment_rows)
        r = r.drop("_pos").repartition(tasks_for(df), key, date)
    else:
        r = rolling_rows(df, key, order, col, before, strict, name)
    per_day = r.groupBy(key, date).agg(F.count(F.lit(1)).alias("rejoin_copies"),
                                       F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"))
    return r.join(per_day, [key, date])


def rolling_rejoin_rows(df: DataFrame, key: str, date: str, order, col: str, before: int = 14,
                        strict: bool = True, name: str | None = None, segment_rows: int | None = None) -> DataFrame:
    """The reference's rejoin itself: the row-wise rolling sum joined back on
    (entity, day), so that each of the k rows of one (entity, day) comes out
    once with each of the k rolling values (k*k rows). A missing entity or day
    meets itself, as in the reference's join. ``rejoin_copies`` and the day's
    smallest and largest value are added as in ``rolling_rejoin``. The rolled
    rows are written once; both sides of the join are dealt by (entity, day)
    to tasks that follow the rows, and matching rows stream through it."""
    name = name or f"rolling_{col}"
    order = [order] if isinstance(order, str) else list(order)
    if segment_rows:
        r = rolling_rows_segmented(df, key, order[0], order[1:], col, before, strict, name, segment_rows).drop("_pos")
    else:
        r = rolling_rows(df, key, order, col, before, strict, name)
    r = stored(r.withColumn("_at", F.struct(key, date)), "rolled")          # equal where both parts are missing
    tasks = tasks_for(r)
    own = r.select("_at", name).repartition(tasks, "_at")
    per_day = own.groupBy("_at").agg(F.count(F.lit(1)).alias("rejoin_copies"),
                                     F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"))
    return r.drop(name).repartition(tasks, "_at").join(own.join(per_day, "_at"), "_at", "left").drop("_at")


def count_by(df: DataFrame, key: str, col: str, value, name: str = "n") -> DataFrame:
    """Rows per entity where ``col == value``."""
    return df.filter(F.col(col) == F.lit(value)).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def sentiment_counts(df: DataFrame, key: str, review_label: str, tip_label: str,
                     pos: str = "POSITIVE", neg: str = "NEGATIVE") -> DataFrame:
    """The four label counts per entity in one aggregation (the reference
    runs four filter+count passes and three full outer joins; the result is
    the same because all counts come from one table). Entities with no
    labelled row are absent, as there."""
    r, t = F.col(review_label), F.col(tip_label)
    labelled = df.filter(r.isin(pos, neg) | t.isin(pos, neg))
    return labelled.groupBy(key).agg(
        F.count_if(r == pos).alias("n_positive_reviews"),
        F.count_if(r == neg).alias("n_negative_reviews"),
        F.count_if(t == pos).alias("n_positive_tips"),
        F.count_if(t == neg).alias("n_negative_tips"))


def sentiment_share(df: DataFrame, key: str, review_label: str, tip_label: str,
                    pos: str = "POSITIVE", neg: str = "NEGATIVE", digits: int = 2) -> DataFrame:
    """share_positive = (positive reviews + tips) / all labelled, rounded
    half-to-even to ``digits``; likewise negative."""
    c = sentiment_counts(df, key, review_label, tip_label, pos, neg)
    p = F.col("n_positive_reviews") + F.col("n_positive_tips")
    n = F.col("n_negative_reviews") + F.col("n_negative_tips")
    return c.select(key,
                    F.bround(F.try_divide(p, p + n), digits).alias("share_positive_feedback"),
                    F.bround(F.try_divide(n, p + n), digits).alias("share_negative_feedback"))


def add_calendar(df: DataFrame, date: str, weekend: str | None = "WE",
                 quarter: str | None = "Quarter", month: str | None = None) -> DataFrame:
    cols = {}
    if weekend:
        cols[weekend] = C.weekend_flag(date)
    if quarter:
        cols[quarter] = C.quarter_label(date)
    if month:
        cols[month] = C.month_floor(date)
    return df.withColumns(cols)


def monthly(df: DataFrame, date: str, aggs: dict, month: str = "month") -> DataFrame:
    """Per-day values (one value per day, repeated rows allowed) -> month.
    ``aggs`` = {out: (fn_name, col)} with fn_name in sum/avg/min/max."""
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    days = df.select(date, *{c for _, c in aggs.values()}).dropDuplicates([date])
    return (days.groupBy(C.month_floor(date).alias(month))
                .agg(*[fns[f](c).alias(o) for o, (f, c) in aggs.items()]))


def entity_series(df: DataFrame, key: str, value, date: str, cols) -> DataFrame:
    """One entity's rows over time (filter is pushed to the scan)."""
    return df.filter(F.col(key) == F.lit(value)).select(date, *cols).orderBy(date)
