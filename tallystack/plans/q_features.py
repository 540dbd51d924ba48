"""Aggregations, windows, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import evaluate, features, profile, relate
from tallystack.operators.clean import filter_eq as op_filter_eq
from tallystack.plans.registry import query
from tallystack.plans.tables import FACTS_SQL, T, facts, r6


def _day():
    return F.col("day").cast("string").alias("day")


@query("count_by", "SELECT source, count(*) AS n_positive_reviews FROM documents d JOIN labels l "
                   "ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY source")
def count_by(spark, sf):
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id")
    return features.count_by(d, "source", "quality", 1, "n_positive_reviews")


SENT_SQL = """sent AS (SELECT d.source, d.lang,
  CASE l.quality WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS review_sent_label,
  CASE WHEN d.n_chars % 3 = 0 THEN NULL WHEN l.toxic = 0 THEN 'POSITIVE' WHEN l.toxic = 1 THEN 'NEGATIVE' END AS tips_sent_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def sentiment_rows(spark, sf):
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    return d.select("source", "lang",
                    F.when(q == 1, "POSITIVE").when(q == 0, "NEGATIVE").alias("review_sent_label"),
                    F.when(F.col("n_chars") % 3 == 0, F.lit(None)).when(t == 0, "POSITIVE")
                     .when(t == 1, "NEGATIVE").alias("tips_sent_label"))


@query("sentiment_share", f"""WITH {SENT_SQL},
c AS (SELECT source || '/' || lang AS key,
        count(CASE WHEN review_sent_label = 'POSITIVE' THEN 1 END) + count(CASE WHEN tips_sent_label = 'POSITIVE' THEN 1 END) AS p,
        count(CASE WHEN review_sent_label = 'NEGATIVE' THEN 1 END) + count(CASE WHEN tips_sent_label = 'NEGATIVE' THEN 1 END) AS n
      FROM sent WHERE review_sent_label IS NOT NULL OR tips_sent_label IS NOT NULL GROUP BY 1)
SELECT key, round_even(p / (p + n), 2) AS share_positive_feedback,
       round_even(n / (p + n), 2) AS share_negative_feedback FROM c""")
def sentiment_share(spark, sf):
    s = sentiment_rows(spark, sf).withColumn("key", F.concat_ws("/", "source", "lang"))
    return features.sentiment_share(s, "key", "review_sent_label", "tips_sent_label")


@query("entity_means", """SELECT l_suppkey,
  round(CASE WHEN count(q) = count(*) THEN avg(q) END, 6) AS mean_qty,
  round(avg(l_extendedprice), 6) AS mean_price,
  round(CASE WHEN count(d) = count(*) THEN avg(d) END, 6) AS mean_disc
FROM (SELECT l_suppkey, l_extendedprice,
        CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE l_quantity END AS q,
        CASE WHEN l_orderkey % 9973 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem)
GROUP BY l_suppkey""")
def entity_means(spark, sf):
    li = T(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    li = li.select("l_suppkey", "l_extendedprice",
                   F.when(k % 997 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("q"),
                   F.when(k % 9973 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("d"))
    m = profile.entity_means(li, "l_suppkey", ["q", "d"], True, ["mean_qty", "mean_disc"])
    p = li.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean_price"))
    j = m.join(p, "l_suppkey")
    return j.select("l_suppkey", *[r6(c).alias(c) for c in ("mean_qty", "mean_price", "mean_disc")])


@query("monthly_climate", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders,
  max(o_totalprice) AS temp_avg FROM orders
  WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1)
SELECT CAST(date_trunc('month', day) AS DATE)::VARCHAR AS month, CAST(sum(n_orders) AS BIGINT) AS precipitation,
  round(avg(temp_avg), 6) AS temp_avg FROM d GROUP BY 1""")
def monthly_climate(spark, sf):
    """Weather stand-in repeated per supplier-day (as the reference's table
    is), reduced to distinct days, then to months."""
    from tallystack.plans.q_relate import daily
    f = facts(spark, sf).select("l_suppkey", "day").join(daily(spark, sf), "day")
    m = features.monthly(f, "day", {"precipitation": ("sum", "n_orders"), "temp_avg": ("avg", "temp_avg")})
    return m.select(F.col("month").cast("string").alias("month"), "precipitation",
                    r6("temp_avg").alias("temp_avg"))


GEO_SQL = """geo AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  label FROM embeddings)"""


def geo(spark, sf):
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
                    F.element_at("embedding", 2).cast("double").alias("y"), "label")


@query("geo_density", f"""WITH {GEO_SQL}
SELECT CAST(floor(x / 0.05) AS BIGINT) AS cell_x, CAST(floor(y / 0.05) AS BIGINT) AS cell_y, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM geo WHERE x IS NOT NULL AND y IS NOT NULL), 6) AS share
FROM geo WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def geo_density(spark, sf):
    d = profile.grid_density(geo(spark, sf), "x", "y", 0.05)
    return d.select(F.col("cell_x").cast("long").alias("cell_x"), F.col("cell_y").cast("long").alias("cell_y"),
                    "n", r6("share").alias("share"))


@query("geo_density_smoothed", f"""WITH {GEO_SQL},
g AS (SELECT floor(x / 0.05) AS cx, floor(y / 0.05) AS cy, count(*) AS n FROM geo
      WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
o AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 2.0) AS w
      FROM (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b),
s AS (SELECT CAST(cx + dx AS BIGINT) AS cell_x, CAST(cy + dy AS BIGINT) AS cell_y, sum(n * w) AS weighted
      FROM g, o GROUP BY 1, 2)
SELECT cell_x, cell_y, round(weighted, 6) AS weighted,
  round(weighted / ((SELECT sum(n) FROM g) * (SELECT sum(w) FROM o)), 6) AS density FROM s""")
def geo_density_smoothed(spark, sf):
    d = profile.grid_density_smoothed(geo(spark, sf), "x", "y", 0.05, radius=2, bandwidth=1.0)
    return d.select(F.col("cell_x").cast("long").alias("cell_x"), F.col("cell_y").cast("long").alias("cell_y"),
                    r6("weighted").alias("weighted"), r6("density").alias("density"))


@query("geo_points", f"WITH {GEO_SQL} SELECT x, y, label FROM geo WHERE x IS NOT NULL AND y IS NOT NULL")
def geo_points(spark, sf):
    return profile.geo_points(geo(spark, sf), "x", "y", "label")


@query("filter_eq", f"WITH {FACTS_SQL} SELECT l_suppkey, CAST(day AS VARCHAR) AS day, n, reach FROM facts WHERE l_suppkey = 7")
def filter_eq(spark, sf):
    return op_filter_eq(facts(spark, sf), "l_suppkey", 7).select("l_suppkey", _day(), "n", "reach")


ROLL_SQL = f"""{FACTS_SQL},
fx AS (SELECT *, CASE WHEN dayofmonth(day) = 13 THEN NULL ELSE reach END AS reach_m FROM facts)"""


def facts_with_gaps(spark, sf):
    f = facts(spark, sf)
    return f.withColumn("reach_m", F.when(F.dayofmonth("day") == 13, F.lit(None)).otherwise(F.col("reach")))


@query("entity_series", f"""WITH {ROLL_SQL}
SELECT CAST(day AS VARCHAR) AS day, reach,
  round(CASE WHEN count(reach) OVER w = count(*) OVER w THEN sum(reach) OVER w END, 4) AS rolling_reach_sum
FROM fx WHERE l_suppkey = 7
WINDOW w AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def entity_series(spark, sf):
    """One supplier's reach and rolling reach over time (rolling computed on
    all rows, then one entity selected; the filter is on the partition key,
    so it is pushed below the window)."""
    f = features.rolling_rows(facts(spark, sf), "l_suppkey", "day", "reach", 14, True, "rolling_reach_sum")
    s = features.entity_series(f, "l_suppkey", 7, "day", ["reach", "rolling_reach_sum"])
    return s.select(_day(), "reach", F.round("rolling_reach_sum", 4).alias("rolling_reach_sum"))


@query("rolling_sum_rows", f"""WITH {ROLL_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day,
  round(CASE WHEN count(reach_m) OVER w = count(*) OVER w THEN sum(reach_m) OVER w END, 4) AS rolling_reach_sum
FROM fx WINDOW w AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def rolling_sum_rows(spark, sf):
    f = features.rolling_rows(facts_with_gaps(spark, sf), "l_suppkey", "day", "reach_m", 14, True,
                              "rolling_reach_sum")
    return f.select("l_suppkey", _day(), F.round("rolling_reach_sum", 4).alias("rolling_reach_sum"))


@query("rolling_sum_days", f"""WITH {ROLL_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day,
  round(CASE WHEN count(reach_m) OVER w = count(*) OVER w THEN sum(reach_m) OVER w END, 4) AS rolling_reach_days
FROM fx WINDOW w AS (PARTITION BY l_suppkey ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW)""")
def rolling_sum_days(spark, sf):
    f = features.rolling_days(facts_with_gaps(spark, sf), "l_suppkey", "day", "reach_m", 14, True,
                              "rolling_reach_days")
    return f.select("l_suppkey", _day(), F.round("rolling_reach_days", 4).alias("rolling_reach_days"))


# Ungrouped rows (a supplier can have several on one day), total order by a
# content key so both engines see the same sequence.
RAW_SQL = """raw AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_partkey,
  l_quantity, l_extendedprice FROM lineitem)"""
RAW_ORDER = "day, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
# rows per window partition for the raw-row rolling sum (hot suppliers are
# cut into segments of this many rows)
SEGMENT_ROWS = 2_000


@query("rolling_rejoin", f"""WITH {RAW_SQL},
r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {RAW_ORDER}
        ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS rolling_qty FROM raw),
s AS (SELECT l_suppkey, day, rolling_qty,
  count(*) OVER (PARTITION BY l_suppkey, day) AS rejoin_copies,
  min(rolling_qty) OVER (PARTITION BY l_suppkey, day) AS rolling_qty_min,
  max(rolling_qty) OVER (PARTITION BY l_suppkey, day) AS rolling_qty_max FROM r)
SELECT r.l_suppkey, CAST(r.day AS VARCHAR) AS day, l_orderkey, l_linenumber, l_partkey, l_quantity, s.rolling_qty,
  rejoin_copies, rolling_qty_min, rolling_qty_max
FROM r LEFT JOIN s ON r.l_suppkey IS NOT DISTINCT FROM s.l_suppkey AND r.day IS NOT DISTINCT FROM s.day""")
def rolling_rejoin(spark, sf):
    li = T(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_orderkey",
                                         "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    order = [c.strip() for c in RAW_ORDER.split(",")]
    r = features.rolling_rejoin_rows(li, "l_suppkey", "day", order, "l_quantity", 14, True, "rolling_qty",
                                     segment_rows=SEGMENT_ROWS)
    return r.select("l_suppkey", _day(), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "rolling_qty",
                    "rejoin_copies", "rolling_qty_min", "rolling_qty_max")


@query("sort_multi", f"WITH {FACTS_SQL} SELECT l_suppkey, CAST(day AS VARCHAR) AS day, n FROM facts ORDER BY l_suppkey, day")
def sort_multi(spark, sf):
    return facts(spark, sf).orderBy("l_suppkey", "day").select("l_suppkey", _day(), "n")


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return relate.distinct_rows(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("union_rows", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'""")
def union_rows(spark, sf):
    o = T(spark, sf, "orders")
    a = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")
    b = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderstatus")
    return relate.append(a, b)


@query("head_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def head_n(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_retailprice")
    return evaluate.head_n(p, [F.col("p_retailprice").desc(), F.col("p_partkey")], 20)


@query("top_n_features", """WITH t AS (SELECT p.p_type || '/' || p.p_name AS feature, sum(l.l_quantity) AS importance
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1)
SELECT feature, importance FROM (SELECT *, rank() OVER (ORDER BY importance DESC) AS rk FROM t) WHERE rk <= 10""")
def top_n_features(spark, sf):
    li = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = li.groupBy(F.concat_ws("/", "p_type", "p_name").alias("feature")).agg(
        F.sum("l_quantity").alias("importance"))
    return evaluate.top_n(t, "importance", 10)


@query("top_rows_by", f"""WITH {FACTS_SQL}, m AS (SELECT l_suppkey, round(avg(reach), 6) AS avg_reach, count(*) AS n_days
  FROM facts GROUP BY l_suppkey)
SELECT l_suppkey, avg_reach, n_days FROM m ORDER BY avg_reach DESC, n_days DESC, l_suppkey LIMIT 3""")
def top_rows_by(spark, sf):
    m = facts(spark, sf).groupBy("l_suppkey").agg(r6(F.avg("reach")).alias("avg_reach"),
                                                  F.count(F.lit(1)).alias("n_days"))
    return evaluate.head_n(m, [F.col("avg_reach").desc(), F.col("n_days").desc(), "l_suppkey"], 3)


@query("cumulative_hits", """SELECT event_id,
  row_number() OVER w AS rank,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_hits
FROM events WINDOW w AS (ORDER BY value DESC, event_id)""")
def cumulative_hits(spark, sf):
    from tallystack.plans.tables import scores
    c = evaluate.cumulative_hits(scores(spark, sf), "score", "label", "event_id")
    return c.select("event_id", "rank", "cum_hits")


@query("rank_by_score", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
def rank_by_score(spark, sf):
    from tallystack.plans.tables import scores
    return evaluate.rank_by_score(scores(spark, sf), "score", "event_id").select("event_id", "rank")
