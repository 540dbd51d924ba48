"""Joins and the star assembly on the driver tables.

supplier = business dimension, facts = business x day, orders per day =
weather, customer/supplier clash for suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.functions import calendar as C
from tallystack.operators import features, relate
from tallystack.operators.relate import join_on
from tallystack.plans.registry import query
from tallystack.plans.tables import FACTS_SQL, T, facts, r6

# Per-day frame from orders (stands in for weather: one row per day).
DAILY_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders,
  max(o_totalprice) AS temp_avg FROM orders GROUP BY 1)"""

# A bound on the rows of a per-day table: one row per calendar day.
DAY_TABLE_MAX_ROWS = 100_000


def daily(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("temp_avg"))


@query("join_inner_renamed_key", f"""WITH {FACTS_SQL}, {DAILY_SQL}
SELECT f.l_suppkey, CAST(f.day AS VARCHAR) AS date_tip, f.reach, d.n_orders, d.temp_avg
FROM facts f JOIN daily d ON f.day = d.day""")
def join_inner_renamed_key(spark, sf):
    f = facts(spark, sf).withColumnRenamed("day", "date_tip")
    j = join_on(f.select("l_suppkey", "date_tip", "reach"), daily(spark, sf), {"date_tip": "day"},
                "inner", broadcast_max_rows=DAY_TABLE_MAX_ROWS)
    return j.select("l_suppkey", F.col("date_tip").cast("string").alias("date_tip"), "reach",
                    "n_orders", "temp_avg")


@query("join_inner", f"""WITH {FACTS_SQL}
SELECT s.s_suppkey, s.s_name, CAST(f.day AS VARCHAR) AS day, f.n
FROM supplier s JOIN facts f ON s.s_suppkey = f.l_suppkey""")
def join_inner(spark, sf):
    s = T(spark, sf, "supplier").select("s_suppkey", "s_name")
    j = join_on(s, facts(spark, sf).select("l_suppkey", "day", "n"), {"s_suppkey": "l_suppkey"}, "inner")
    return j.select("s_suppkey", "s_name", F.col("day").cast("string").alias("day"), "n")


@query("join_left", """SELECT c.c_custkey, c.c_name, o.n_orders, round(o.total, 2) AS total
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total
                           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def join_left(spark, sf):
    o = T(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    j = join_on(T(spark, sf, "customer").select("c_custkey", "c_name"), o, {"c_custkey": "o_custkey"}, "left")
    return j.select("c_custkey", "c_name", "n_orders", F.round("total", 2).alias("total"))


RETURNS_SQL = """ret AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n_returned,
  sum(l_quantity) AS qty_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def returns(spark, sf):
    li = T(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    return li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_returned"), F.sum("l_quantity").alias("qty_returned"))


@query("join_left_composite", f"""WITH {FACTS_SQL}, {RETURNS_SQL}
SELECT f.l_suppkey, CAST(f.day AS VARCHAR) AS day, f.n, r.n_returned, r.qty_returned
FROM facts f LEFT JOIN ret r ON f.l_suppkey = r.l_suppkey AND f.day = r.day""")
def join_left_composite(spark, sf):
    j = join_on(facts(spark, sf).select("l_suppkey", "day", "n"), returns(spark, sf),
                ["l_suppkey", "day"], "left")
    return j.select("l_suppkey", F.col("day").cast("string").alias("day"), "n", "n_returned", "qty_returned")


@query("join_left_self", f"""WITH {FACTS_SQL},
r AS (SELECT l_suppkey, day, CASE WHEN count(reach) OVER w = count(*) OVER w THEN sum(reach) OVER w END AS rolling_reach_sum
      FROM facts WINDOW w AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT f.l_suppkey, CAST(f.day AS VARCHAR) AS day, f.reach, round(r.rolling_reach_sum, 4) AS rolling_reach_sum
FROM facts f LEFT JOIN r ON f.l_suppkey = r.l_suppkey AND f.day = r.day""")
def join_left_self(spark, sf):
    """Rolling result joined back on (entity, day): the facts are one row per
    key, so the join is 1:1 (the window column form avoids it entirely)."""
    f = facts(spark, sf)
    r = features.rolling_rows(f.select("l_suppkey", "day", "reach"), "l_suppkey", "day", "reach",
                              14, True, "rolling_reach_sum").drop("reach")
    j = join_on(f.select("l_suppkey", "day", "reach"), r, ["l_suppkey", "day"], "left")
    return j.select("l_suppkey", F.col("day").cast("string").alias("day"), "reach",
                    F.round("rolling_reach_sum", 4).alias("rolling_reach_sum"))


# Label counts per (source, language) from documents x labels: sparse keys,
# so the full outer joins meet missing sides.
LABELLED_SQL = """lab AS (SELECT d.source || '/' || d.lang AS key, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark, sf):
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id")
    return d.select(F.concat_ws("/", "source", "lang").alias("key"), "quality", "toxic")


@query("join_full", f"""WITH {LABELLED_SQL},
a AS (SELECT key, count(*) AS n_positive_reviews FROM lab WHERE quality = 1 AND toxic = 0 GROUP BY key),
b AS (SELECT key, count(*) AS n_negative_reviews FROM lab WHERE quality = 0 GROUP BY key),
c AS (SELECT key, count(*) AS n_positive_tips FROM lab WHERE toxic = 0 AND quality = 0 GROUP BY key),
d AS (SELECT key, count(*) AS n_negative_tips FROM lab WHERE toxic = 1 GROUP BY key)
SELECT coalesce(a.key, b.key, c.key, d.key) AS key, n_positive_reviews, n_negative_reviews, n_positive_tips, n_negative_tips
FROM a FULL JOIN b ON a.key = b.key
       FULL JOIN c ON coalesce(a.key, b.key) = c.key
       FULL JOIN d ON coalesce(a.key, b.key, c.key) = d.key""")
def join_full(spark, sf):
    lab = labelled(spark, sf)
    q, t = F.col("quality"), F.col("toxic")
    parts = [lab.filter((q == 1) & (t == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n_positive_reviews")),
             lab.filter(q == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n_negative_reviews")),
             lab.filter((t == 0) & (q == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n_positive_tips")),
             lab.filter(t == 1).groupBy("key").agg(F.count(F.lit(1)).alias("n_negative_tips"))]
    return relate.outer_chain(parts, ["key"])


@query("join_suffix", """SELECT c.c_custkey, c.c_nationkey AS nation,
  c.c_name AS name_x, n.n_name AS name_y, c.c_custkey % 7 AS region_x, n.n_regionkey AS region_y
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_suffix(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"),
                                        F.col("c_name").alias("name"), (F.col("c_custkey") % 7).alias("region"))
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"),
                                      F.col("n_regionkey").alias("region"))
    return join_on(c, n, ["nation"], "inner")


# ------------------------------------------------------------------ star

STAR_SQL = f"""{FACTS_SQL}, {DAILY_SQL}, {RETURNS_SQL},
ps AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_photo FROM lineitem GROUP BY l_suppkey),
st AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS avg_stars_us, count(*) AS n_reviews_us FROM lineitem GROUP BY l_suppkey),
au AS (SELECT l_suppkey, round(avg(l_discount), 6) AS avg_n_fans_bus FROM lineitem GROUP BY l_suppkey),
fd AS (SELECT f.*, d.n_orders, d.temp_avg FROM facts f JOIN daily d ON f.day = d.day)"""

STAR_SELECT = """SELECT s.s_suppkey, s.s_name, ps.n_photo, st.avg_stars_us, st.n_reviews_us,
  CAST(fd.day AS VARCHAR) AS day, fd.n, fd.reach, fd.hits, fd.n_orders, fd.temp_avg,
  r.n_returned, r.qty_returned, au.avg_n_fans_bus
FROM supplier s LEFT JOIN ps ON s.s_suppkey = ps.l_suppkey
  LEFT JOIN st ON s.s_suppkey = st.l_suppkey
  JOIN fd ON s.s_suppkey = fd.l_suppkey
  LEFT JOIN ret r ON fd.l_suppkey = r.l_suppkey AND fd.day = r.day
  LEFT JOIN au ON s.s_suppkey = au.l_suppkey"""


def star(spark, sf, parity=False):
    li = T(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_distinct("l_partkey").alias("n_photo"), r6(F.avg("l_quantity")).alias("avg_stars_us"),
        F.count(F.lit(1)).alias("n_reviews_us"), r6(F.avg("l_discount")).alias("avg_n_fans_bus"))
    fd = join_on(facts(spark, sf), daily(spark, sf), ["day"], "inner", broadcast_max_rows=DAY_TABLE_MAX_ROWS)
    fd = fd.withColumnRenamed("l_suppkey", "s_suppkey")
    ret = returns(spark, sf).withColumnRenamed("l_suppkey", "s_suppkey")
    dim = T(spark, sf, "supplier").select("s_suppkey", "s_name")
    out = relate.assemble(dim, "s_suppkey", fd, "day", dim_left=[per], daily_left=[ret], parity=parity)
    return out.select("s_suppkey", "s_name", "n_photo", "avg_stars_us", "n_reviews_us",
                      F.col("day").cast("string").alias("day"), "n", "reach", "hits", "n_orders", "temp_avg",
                      "n_returned", "qty_returned", "avg_n_fans_bus")


@query("star_assembly", f"WITH {STAR_SQL} {STAR_SELECT}")
def star_assembly(spark, sf):
    return star(spark, sf, parity=False)


@query("star_assembly_parity", f"WITH {STAR_SQL} SELECT DISTINCT * FROM ({STAR_SELECT})")
def star_assembly_parity(spark, sf):
    """The reference's variant: full-row de-duplication after daily joins."""
    return star(spark, sf, parity=True)


# --------------------------------------------------------------- flagship

FLAGSHIP_SQL = f"""WITH {FACTS_SQL}, {DAILY_SQL},
j AS (SELECT s.s_suppkey, s.s_name, s.s_nationkey, f.day, f.n, f.reach, d.n_orders, d.temp_avg
      FROM supplier s JOIN facts f ON s.s_suppkey = f.l_suppkey JOIN daily d ON f.day = d.day)
SELECT s_suppkey, s_name, s_nationkey, CAST(day AS VARCHAR) AS day, n, reach, n_orders, temp_avg,
  round(CASE WHEN count(reach) OVER w = count(*) OVER w THEN sum(reach) OVER w END, 4) AS rolling_reach_sum,
  CAST(isodow(day) IN (6, 7) AS INTEGER) AS WE, 'Q' || quarter(day) AS Quarter
FROM j WINDOW w AS (PARTITION BY s_suppkey ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Minimum slice: facts -> join per-day frame and supplier -> 15-row
    rolling reach -> weekend and quarter."""
    f = join_on(facts(spark, sf), daily(spark, sf), ["day"], "inner", broadcast_max_rows=DAY_TABLE_MAX_ROWS)
    s = T(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    j = join_on(s, f, {"s_suppkey": "l_suppkey"}, "inner")
    j = features.rolling_rows(j, "s_suppkey", "day", "reach", 14, True, "rolling_reach_sum")
    j = features.add_calendar(j, "day")
    return j.select("s_suppkey", "s_name", "s_nationkey", F.col("day").cast("string").alias("day"), "n",
                    "reach", "n_orders", "temp_avg", F.round("rolling_reach_sum", 4).alias("rolling_reach_sum"),
                    F.col("WE").cast("int").alias("WE"), "Quarter")
