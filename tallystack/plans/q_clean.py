"""Projections and recoding on part (business-like text), orders and
customer (categories), and the facts (flags and labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.functions import calendar as C
from tallystack.functions import units as U
from tallystack.operators import clean
from tallystack.operators.prep import dummy_code
from tallystack.plans.registry import query
from tallystack.plans.tables import (DAYS, FACTS_SQL, HOUR_COLS, T, business, facts, hours_sql,
                                     hours_text_sql, r6)


def cleaned_business(spark, sf):
    """The reference's business clean-up: strip quotes, hours per weekday,
    text NULL -> missing."""
    b = business(spark, sf)
    b = clean.strip_first(b, ["alcohol", "noise_level"])
    b = clean.strip_all(b, [f"{d}_open_hours" for d in DAYS])
    b = clean.add_open_hours(b, {h: f"{d}_open_hours" for h, d in zip(HOUR_COLS, DAYS)})
    return clean.null_text_to_null(b)


ALCOHOL_SQL = ("CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) "
               "WHEN p_partkey % 7 = 0 THEN lower(p_type) || 'x''' ELSE lower(p_type) END")


NOISE_SQL = "CASE WHEN p_partkey % 13 = 0 THEN 'NULL' ELSE lower(p_brand) END"


@query("strip_first", f"SELECT p_partkey, {ALCOHOL_SQL} AS alcohol, {NOISE_SQL} AS noise_level FROM part")
def strip_first(spark, sf):
    b = clean.strip_first(business(spark, sf), ["alcohol", "noise_level"])
    return b.select("p_partkey", "alcohol", "noise_level")


@query("strip_all", "SELECT p_partkey, " + ", ".join(
    f"{hours_text_sql(d)} AS {day}_open_hours" for d, day in enumerate(DAYS)) + " FROM part")
def strip_all(spark, sf):
    cols = [f"{day}_open_hours" for day in DAYS]
    return clean.strip_all(business(spark, sf), cols).select("p_partkey", *cols)


@query("open_hours", "SELECT p_partkey, " + ", ".join(
    f"round({hours_sql(d)}, 6) AS {h}" for d, h in enumerate(HOUR_COLS)) + " FROM part")
def open_hours(spark, sf):
    b = cleaned_business(spark, sf)
    return b.select("p_partkey", *[r6(h).alias(h) for h in HOUR_COLS])


@query("null_text_to_null", f"SELECT p_partkey, {ALCOHOL_SQL} AS alcohol, nullif({NOISE_SQL}, 'NULL') AS noise_level, "
       + ", ".join(f"nullif({hours_text_sql(d)}, 'NULL') AS {day}_open_hours" for d, day in enumerate(DAYS)) + " FROM part")
def null_text_to_null(spark, sf):
    cols = [f"{day}_open_hours" for day in DAYS]
    b = clean.strip_all(clean.strip_first(business(spark, sf), ["alcohol", "noise_level"]), cols)
    return clean.null_text_to_null(b).select("p_partkey", "alcohol", "noise_level", *cols)


@query("fill_const", "SELECT p_partkey, " + ", ".join(
    f"round(coalesce({hours_sql(d)}, 0), 6) AS {h}" for d, h in enumerate(HOUR_COLS)) + " FROM part")
def fill_const(spark, sf):
    b = clean.fill_const(cleaned_business(spark, sf), {h: 0.0 for h in HOUR_COLS})
    return b.select("p_partkey", *[r6(h).alias(h) for h in HOUR_COLS])


@query("row_sum", "SELECT p_partkey, round(" + " + ".join(
    f"coalesce({hours_sql(d)}, 0)" for d in range(7)) + ", 6) AS open_hours_week FROM part")
def row_sum(spark, sf):
    b = clean.row_sum(cleaned_business(spark, sf), HOUR_COLS, "open_hours_week")
    return b.select("p_partkey", r6("open_hours_week").alias("open_hours_week"))


# ----------------------------------------------------------------- orders

@query("recode_value", """SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '1_URGENT' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def recode_value(spark, sf):
    o = clean.recode(T(spark, sf, "orders"), "o_orderpriority", {"1-URGENT": "1_URGENT"})
    return o.select("o_orderkey", "o_orderpriority")


@query("collapse_levels", """SELECT o_orderkey,
  CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'URGENT' WHEN o_orderpriority LIKE '%HIGH%' THEN 'HIGH'
       WHEN o_orderpriority LIKE '%LOW%' THEN 'LOW' ELSE 'Others' END AS priority_group
FROM orders""")
def collapse_levels(spark, sf):
    o = clean.collapse_levels(T(spark, sf, "orders"), "o_orderpriority", ["URGENT", "HIGH", "LOW"],
                              "Others", "priority_group")
    return o.select("o_orderkey", "priority_group")


@query("rename_cols", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders")
def rename_cols(spark, sf):
    o = clean.rename_cols(T(spark, sf, "orders"), {"o_orderkey": "order_id", "o_totalprice": "total"})
    return o.select("order_id", "total")


@query("select_cols", "SELECT o_orderkey, o_orderstatus FROM orders")
def select_cols(spark, sf):
    return clean.select_cols(T(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_cols(spark, sf):
    return clean.drop_cols(T(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "o_orderpriority"])


@query("to_number", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS priority_num
FROM orders""")
def to_number(spark, sf):
    o = T(spark, sf, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.lit("NULL"))
                 .otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority_num"))
    return clean.to_number(o, ["priority_num"])


@query("bool_to_num", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0
       ELSE NULL END AS fulfilled
FROM orders""")
def bool_to_num(spark, sf):
    o = T(spark, sf, "orders")
    txt = (F.when(F.col("o_orderkey") % 10 == 0, F.lit("yes"))
            .when(F.col("o_orderstatus") == "F", F.lit("TRUE"))
            .when(F.col("o_orderstatus") == "O", F.lit("FALSE")))
    return clean.bool_to_num(o.select("o_orderkey", txt.alias("fulfilled")), ["fulfilled"])


def _dated(spark, sf):
    """Order dates as text: '/' or '-' separators, unpadded, some invalid."""
    o = T(spark, sf, "orders")
    k = F.col("o_orderkey")
    txt = (F.when(k % 17 == 0, F.lit("bad"))
            .when(k % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .otherwise(F.date_format("o_orderdate", "yyyy-M-d")))
    return o.select("o_orderkey", C.to_date_safe(txt).alias("d"))


DATED_SQL = """dated AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)"""


@query("to_date", f"WITH {DATED_SQL} SELECT o_orderkey, CAST(d AS VARCHAR) AS d FROM dated")
def to_date(spark, sf):
    return _dated(spark, sf).select("o_orderkey", F.col("d").cast("string").alias("d"))


@query("weekend_flag", f"WITH {DATED_SQL} SELECT o_orderkey, CAST(isodow(d) IN (6, 7) AS INTEGER) AS WE FROM dated")
def weekend_flag(spark, sf):
    return _dated(spark, sf).select("o_orderkey", C.weekend_flag("d").cast("int").alias("WE"))


@query("quarter_label", f"WITH {DATED_SQL} SELECT o_orderkey, 'Q' || quarter(d) AS Quarter FROM dated")
def quarter_label(spark, sf):
    return _dated(spark, sf).select("o_orderkey", C.quarter_label("d").alias("Quarter"))


@query("month_floor", f"""WITH {DATED_SQL}
SELECT o_orderkey, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month FROM dated""")
def month_floor(spark, sf):
    return _dated(spark, sf).select("o_orderkey", C.month_floor("d").cast("string").alias("month"))


@query("f_to_c", "SELECT p_partkey, round((CAST(p_size AS DOUBLE) - 32) * 5 / 9, 2) AS temp_avg FROM part")
def f_to_c(spark, sf):
    return T(spark, sf, "part").select("p_partkey", U.f_to_c(F.col("p_size").cast("double")).alias("temp_avg"))


@query("in_to_mm", "SELECT p_partkey, round(p_retailprice / 100 * 25.4, 6) AS precipitation FROM part")
def in_to_mm(spark, sf):
    p = T(spark, sf, "part")
    return p.select("p_partkey", r6(U.in_to_mm(F.col("p_retailprice") / 100)).alias("precipitation"))


@query("round_n", "SELECT p_partkey, round_even(CAST(p_size AS DOUBLE) / 8, 2) AS share FROM part")
def round_n(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("double") / 8).alias("share"))
    return clean.round_even(p, ["share"], 2)


# --------------------------------------------------------------- factors

@query("to_factor", """SELECT level, CAST(row_number() OVER (ORDER BY level) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT c_mktsegment AS level FROM customer WHERE c_mktsegment IS NOT NULL)""")
def to_factor(spark, sf):
    lv = clean.levels_of(T(spark, sf, "customer"), "c_mktsegment")
    return lv.select("level", F.col("idx").cast("long").alias("idx"))


@query("relevel", """SELECT level, CAST(row_number() OVER (ORDER BY CASE WHEN level = 'MACHINERY' THEN 0 ELSE 1 END, level) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT c_mktsegment AS level FROM customer WHERE c_mktsegment IS NOT NULL)""")
def relevel(spark, sf):
    lv = clean.levels_of(T(spark, sf, "customer"), "c_mktsegment", ref="MACHINERY")
    return lv.select("level", F.col("idx").cast("long").alias("idx"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("dummy_code", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS)
    + " FROM customer")
def dummy_code_q(spark, sf):
    c = T(spark, sf, "customer")
    lv = clean.level_list(c, "c_mktsegment")
    return dummy_code(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", lv)


@query("drop_base_level", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS
    if s != "MACHINERY") + " FROM customer")
def drop_base_level(spark, sf):
    c = T(spark, sf, "customer")
    lv = clean.level_list(c, "c_mktsegment", ref="MACHINERY")
    return dummy_code(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", lv, drop_base=True)


# ------------------------------------------------------------ facts flags

@query("gate_by_flag", f"""WITH {FACTS_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day,
  CASE WHEN hits IS NULL THEN NULL WHEN hits = 0 THEN 0 ELSE reach END AS reach_gated FROM facts""")
def gate_by_flag(spark, sf):
    f = facts(spark, sf).withColumn("reach_gated", F.col("reach"))
    f = clean.gate_by_flag(f, "hits", ["reach_gated"])
    return f.select("l_suppkey", F.col("day").cast("string").alias("day"), "reach_gated")


@query("row_expr", f"""WITH {FACTS_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round(reach + n + hits, 4) AS total FROM facts""")
def row_expr(spark, sf):
    f = clean.add_sum(facts(spark, sf), ["reach", "n", "hits"], "total")
    return f.select("l_suppkey", F.col("day").cast("string").alias("day"), F.round("total", 4).alias("total"))


@query("label_text", f"""WITH {FACTS_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day,
  CASE WHEN hits >= 1 THEN 'ch_in' WHEN hits = 0 THEN 'Noch_in' END AS ch_in_string FROM facts""")
def label_text(spark, sf):
    f = clean.label_text(facts(spark, sf), "hits", "ch_in_string")
    return f.select("l_suppkey", F.col("day").cast("string").alias("day"), "ch_in_string")


@query("label_num", f"""WITH {FACTS_SQL}
SELECT l_suppkey, CAST(day AS VARCHAR) AS day,
  CASE WHEN hits IS NULL THEN NULL WHEN hits = 1 THEN 1 ELSE 0 END AS label FROM facts""")
def label_num(spark, sf):
    f = clean.label_num(facts(spark, sf), "hits", "label", 1)
    return f.select("l_suppkey", F.col("day").cast("string").alias("day"), "label")
