"""Upstream extracts rebuilt on the driver tables.

events stands in for check-ins (purchase), tips (click) and reach (value);
lineitem x orders x customer stands in for posts x users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import extract
from tallystack.plans.registry import query
from tallystack.plans.tables import T, r6

GRID_SQL = """b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
g AS (SELECT u.user_id, CAST(d.day AS DATE) AS day
      FROM (SELECT DISTINCT user_id FROM events) u,
           (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b) d),
c AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_purchase,
             CAST(count_if(event_type = 'click') AS BIGINT) AS n_click, max(value) AS max_value
      FROM events GROUP BY 1, 2),
grid AS (SELECT g.user_id, g.day, coalesce(c.n_purchase, 0) AS n_purchase,
                coalesce(c.n_click, 0) AS n_click, c.max_value
         FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.day = c.day)"""


def grid(spark, sf):
    ev = T(spark, sf, "events")
    g = extract.daily_grid(ev, "user_id", "ts", F.col("event_type") == "purchase",
                           count_name="n_purchase", flag="ch_in")
    day_stats = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "click").alias("n_click"), F.max("value").alias("max_value"))
    g = g.join(day_stats, ["user_id", "day"], "left")
    return g.withColumn("n_click", F.coalesce(F.col("n_click"), F.lit(0)))


@query("daily_checkin_flag", f"""WITH {GRID_SQL}
SELECT user_id, CAST(day AS VARCHAR) AS day, n_purchase,
       CASE WHEN n_purchase > 0 THEN 1 ELSE 0 END AS ch_in FROM grid""")
def daily_checkin_flag(spark, sf):
    g = grid(spark, sf)
    return g.select("user_id", F.col("day").cast("string").alias("day"), "n_purchase", "ch_in")


@query("cum_tip_count", f"""WITH {GRID_SQL}
SELECT user_id, CAST(day AS VARCHAR) AS day,
       CAST(sum(n_click) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_n_tips
FROM grid""")
def cum_tip_count(spark, sf):
    g = extract.cumulative(grid(spark, sf), "user_id", "day", "n_click", "sum", "cum_n_tips")
    return g.select("user_id", F.col("day").cast("string").alias("day"), "cum_n_tips")


@query("cum_max_elite", f"""WITH {GRID_SQL}
SELECT user_id, CAST(day AS VARCHAR) AS day,
       max(max_value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_max_u_elite
FROM grid""")
def cum_max_elite(spark, sf):
    g = extract.cumulative(grid(spark, sf), "user_id", "day", "max_value", "max", "cum_max_u_elite")
    return g.select("user_id", F.col("day").cast("string").alias("day"), "cum_max_u_elite")


@query("cum_max_user_tips", f"""WITH {GRID_SQL}
SELECT user_id, CAST(day AS VARCHAR) AS day,
       max(n_click) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_max_us_tip
FROM grid""")
def cum_max_user_tips(spark, sf):
    g = extract.cumulative(grid(spark, sf), "user_id", "day", "n_click", "max", "cum_max_us_tip")
    return g.select("user_id", F.col("day").cast("string").alias("day"), "cum_max_us_tip")


# posts = lineitem rows (supplier = business) joined to orders for the user
USERS_SQL = """users AS (SELECT c.c_custkey AS user_id, c.c_acctbal AS n_fans,
                 CAST(count(o.o_orderkey) AS BIGINT) AS n_friends
          FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
          GROUP BY c.c_custkey, c.c_acctbal),
posts AS (SELECT l.l_suppkey, CAST(o.o_orderdate AS DATE) AS day, o.o_custkey AS user_id
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def users(spark, sf):
    c = T(spark, sf, "customer")
    o = T(spark, sf, "orders")
    cnt = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_friends"))
    return (c.join(cnt, c.c_custkey == cnt.o_custkey, "left")
             .select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("n_fans"),
                     F.coalesce(F.col("n_friends"), F.lit(0)).alias("n_friends")))


def posts(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_suppkey", F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("user_id"))


@query("avg_friends_fans", f"""WITH {USERS_SQL}
SELECT p.l_suppkey, round(avg(u.n_friends), 6) AS avg_n_friends_bus, round(avg(u.n_fans), 6) AS avg_n_fans_bus
FROM (SELECT DISTINCT l_suppkey, user_id FROM posts) p JOIN users u ON p.user_id = u.user_id
GROUP BY p.l_suppkey""")
def avg_friends_fans(spark, sf):
    a = extract.audience_mean(posts(spark, sf), users(spark, sf), "l_suppkey", "user_id",
                              ["n_friends", "n_fans"], ["avg_n_friends_bus", "avg_n_fans_bus"])
    return a.select("l_suppkey", r6("avg_n_friends_bus").alias("avg_n_friends_bus"),
                    r6("avg_n_fans_bus").alias("avg_n_fans_bus"))


@query("reached_fans_daily", f"""WITH {USERS_SQL}
SELECT p.l_suppkey, CAST(p.day AS VARCHAR) AS day, round(sum(u.n_fans), 2) AS n_reached_fans
FROM posts p JOIN users u ON p.user_id = u.user_id GROUP BY p.l_suppkey, p.day""")
def reached_fans_daily(spark, sf):
    r = extract.reach_daily(posts(spark, sf), users(spark, sf), "l_suppkey", "day", "user_id",
                            "n_fans", "n_reached_fans")
    return r.select("l_suppkey", F.col("day").cast("string").alias("day"),
                    F.round("n_reached_fans", 2).alias("n_reached_fans"))


@query("reached_friends_daily", f"""WITH {USERS_SQL}
SELECT p.l_suppkey, CAST(p.day AS VARCHAR) AS day, CAST(sum(u.n_friends) AS BIGINT) AS n_reached_friends
FROM posts p JOIN users u ON p.user_id = u.user_id GROUP BY p.l_suppkey, p.day""")
def reached_friends_daily(spark, sf):
    r = extract.reach_daily(posts(spark, sf), users(spark, sf), "l_suppkey", "day", "user_id",
                            "n_friends", "n_reached_friends")
    return r.select("l_suppkey", F.col("day").cast("string").alias("day"), "n_reached_friends")


@query("photo_count", "SELECT source, count(*) AS n_photo FROM documents GROUP BY source")
def photo_count(spark, sf):
    return extract.count_per(T(spark, sf, "documents"), "source", "n_photo")


@query("review_stats", """SELECT d.source, round(avg(l.quality), 6) AS avg_stars_us, count(*) AS n_reviews_us,
  CAST(sum(l.toxic) AS BIGINT) AS funny, CAST(sum(d.n_chars) AS BIGINT) AS usefull
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def review_stats(spark, sf):
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    r = extract.review_stats(d, "source", {"avg_stars_us": "quality"}, "n_reviews_us",
                             {"funny": "toxic", "usefull": "n_chars"})
    return r.select("source", r6("avg_stars_us").alias("avg_stars_us"), "n_reviews_us",
                    F.col("funny").cast("long").alias("funny"), "usefull")
