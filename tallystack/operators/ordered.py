"""Global rank and running sums without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one
task. Instead:

1. Rows are range-partitioned on the complete order (score, then every tie
   column, of any orderable type). Spark samples the boundaries; they are
   compared on all order columns, so a score that a third of all rows share is
   split by its ties, and text or 64-bit ids keep their exact order. The
   partition number is the bucket; the result is written once to the shared
   folder, so that every later use sees the same buckets.
2. Rows and sums per bucket form a table with one row per bucket, whatever
   the data; its prefix sums are broadcast.
3. A window partitioned by bucket adds the in-bucket running values.

The total order is (score desc|asc, ties asc); null and NaN scores sort last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystack.session import shared_dir


def _positions(df: DataFrame, order: list, sums: dict, rank_col: str, total_col: str | None,
               n_buckets: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n_buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_dir(spark, "ordered")
    (df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id())).write.parquet(path)
    keyed = spark.read.parquet(path)

    stats = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"),
                                    *[F.sum(expr).alias(f"_bs_{k}") for k, expr in sums.items()])
    # bounded: one row per bucket
    w_prev = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy()
    offs = [F.coalesce(F.sum("_bn").over(w_prev), F.lit(0)).alias("_off_n")]
    offs += [F.coalesce(F.sum(f"_bs_{k}").over(w_prev), F.lit(0)).alias(f"_off_{k}") for k in sums]
    if total_col:
        offs.append(F.sum("_bn").over(w_all).alias(total_col))
    offs += [F.sum(f"_bs_{k}").over(w_all).alias(f"{k}_total") for k in sums]
    offsets = stats.select("_b", *offs)

    w_in = Window.partitionBy("_b").orderBy(*order)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = keyed.repartition(n_buckets, "_b") if n_buckets else keyed         # else buckets share the session's partitions
    out = spread.join(F.broadcast(offsets), "_b")
    out = out.withColumn(rank_col, F.col("_off_n") + F.row_number().over(w_in))
    for k, expr in sums.items():
        out = out.withColumn(k, F.col(f"_off_{k}") + F.sum(expr).over(w_run))
    return out.drop("_b", "_off_n", *[f"_off_{k}" for k in sums])


def _score_order(df: DataFrame, score: str, descending: bool) -> list:
    c = F.col(score)
    if dict(df.dtypes)[score] in ("double", "float"):
        c = F.when(F.isnan(c), None).otherwise(c)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last()]


def ordered_prefix(df: DataFrame, score: str, tiebreak, descending: bool = True,
                   sums: dict | None = None, n_buckets: int | None = None,
                   rank_col: str = "rank", total_col: str | None = "n_total") -> DataFrame:
    """Add ``rank_col`` (1-based position in the global order) and, for each
    ``name: expr`` in ``sums``, the running (inclusive) sum in that order.
    ``total_col`` / ``<name>_total`` carry the grand totals.

    ``tiebreak`` is a column name or a list of them (ascending, of any
    orderable type) that makes the order total."""
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    order = _score_order(df, score, descending) + [F.col(t).asc_nulls_last() for t in ties]
    return _positions(df, order, sums or {}, rank_col, total_col, n_buckets)


def grouped_prefix(df: DataFrame, group: str, value: str, ties=(), descending: bool = False,
                   sums: dict | None = None, rank_col: str = "rank") -> DataFrame:
    """``ordered_prefix`` inside each group of a small integer column
    ``group`` (e.g. a feature or model index), in one ordered pass for all
    groups: the order is (group, value, *ties); ranks and running sums
    restart in each group. Adds ``rank_col``, the running sums and
    ``<name>_total`` / ``n_group`` per group."""
    sums = sums or {}
    order = [F.col(group).asc(), *_score_order(df, value, descending), *[F.col(t).asc_nulls_last() for t in ties]]
    o = _positions(df, order, sums, "_grank", None, None)
    # one row per group: totals and the offsets of the earlier groups
    totals = sorted(df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"),
                                          *[F.sum(e).alias(f"_gt_{k}") for k, e in sums.items()]).collect(),
                    key=lambda r: r[group])
    acc_n, acc = 0, {k: 0 for k in sums}
    off_n, off_s, tot_n, tot_s = {}, {k: {} for k in sums}, {}, {k: {} for k in sums}
    for r in totals:
        g = r[group]
        off_n[g], tot_n[g] = acc_n, r["_gn"]
        acc_n += r["_gn"]
        for k in sums:
            off_s[k][g], tot_s[k][g] = acc[k], r[f"_gt_{k}"] or 0
            acc[k] += r[f"_gt_{k}"] or 0

    def lookup(m):
        return F.create_map(*[x for key, v in m.items() for x in (F.lit(key), F.lit(v))])[F.col(group)]
    if not totals:
        off_n = tot_n = {0: 0}
        off_s = tot_s = {k: {0: 0} for k in sums}
    o = o.withColumn(rank_col, F.col("_grank") - lookup(off_n)).withColumn("n_group", lookup(tot_n))
    for k in sums:
        o = (o.withColumn(k, F.col(k) - lookup(off_s[k]))
              .withColumn(f"{k}_total", lookup(tot_s[k])))
    return o.drop("_grank")
