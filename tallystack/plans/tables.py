"""Stand-in frames built from the driver tables, each with its SQL twin.

The SQL twins compute from the integer columns directly (no repeat of the
Spark-side parsing), so they are independent oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystack.sources.io import driver_table

DAYS = ("mon", "tue", "wed", "thr", "fri", "sat", "sun")
HOUR_COLS = ("open_hours_mon", "open_hours_tue", "open_hours_wed", "open_hours_thu",
             "open_hours_fri", "open_hours_sat", "open_hours_sun")


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return driver_table(spark, sf, name)


# ------------------------------------------------------------------ facts
# Business x day facts: lineitem per (supplier, ship day). hits is made
# missing for every 11th supplier to exercise null semantics.

def facts(spark, sf) -> DataFrame:
    li = T(spark, sf, "lineitem")
    g = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("reach"),
        F.count_if(F.col("l_returnflag") == "R").alias("_hits"))
    return g.withColumn("hits", F.when(F.col("l_suppkey") % 11 == 0, F.lit(None))
                        .otherwise(F.col("_hits"))).drop("_hits")


FACTS_SQL = """facts AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS reach,
         CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(count_if(l_returnflag = 'R') AS BIGINT) END AS hits
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""


# ---------------------------------------------------------- business frame
# A business-like table from part: quoted opening-hours text per weekday
# ('NULL' and 'none' markers included) and quoted attribute text.

def _hours_parts(d: int):
    k, s = F.col("p_partkey"), F.col("p_size")
    return ((s + d) % 24, (k + 7 * d) % 60, (s * 7 + 3 * d) % 24, (k * 3 + d) % 60)


def business(spark, sf) -> DataFrame:
    p = T(spark, sf, "part")
    k = F.col("p_partkey")
    cols = {}
    for d, day in enumerate(DAYS):
        sh, sm, eh, em = _hours_parts(d)
        txt = (F.when((k + d) % 7 == 0, F.lit("NULL"))
                .when((k + d) % 11 == 0, F.lit("none"))
                .otherwise(F.concat_ws("", sh.cast("string"), F.lit(":"), sm.cast("string"), F.lit("-"),
                                       eh.cast("string"), F.lit(":"), em.cast("string"))))
        cols[f"{day}_open_hours"] = F.concat(F.lit('"'), txt, F.lit('"'))
    t = F.lower(F.col("p_type"))
    cols["alcohol"] = (F.when(k % 5 == 0, t)
                        .when(k % 7 == 0, F.concat(F.lit("'"), t, F.lit("'x'")))
                        .otherwise(F.concat(F.lit("u'"), t, F.lit("'"))))
    cols["noise_level"] = F.when(k % 13 == 0, F.lit("NULL")).otherwise(
        F.concat(F.lit("u'"), F.lower(F.col("p_brand")), F.lit("'")))
    return p.select("p_partkey", "p_size", "p_retailprice", *[v.alias(n) for n, v in cols.items()])


def hours_sql(d: int) -> str:
    """Hours open on weekday d, from the integers (NULL for the markers)."""
    st = f"(((p_size + {d}) % 24) * 60 + (p_partkey + {7 * d}) % 60)"
    en = f"(((p_size * 7 + {3 * d}) % 24) * 60 + (p_partkey * 3 + {d}) % 60)"
    return (f"CASE WHEN (p_partkey + {d}) % 7 = 0 OR (p_partkey + {d}) % 11 = 0 THEN NULL "
            f"ELSE CAST(CASE WHEN {en} = {st} THEN 1440 WHEN {en} < {st} THEN {en} + 1440 - {st} "
            f"ELSE {en} - {st} END AS DOUBLE) / 60 END")


def hours_text_sql(d: int) -> str:
    return (f"CASE WHEN (p_partkey + {d}) % 7 = 0 THEN 'NULL' WHEN (p_partkey + {d}) % 11 = 0 THEN 'none' "
            f"ELSE concat((p_size + {d}) % 24, ':', (p_partkey + {7 * d}) % 60, '-', "
            f"(p_size * 7 + {3 * d}) % 24, ':', (p_partkey * 3 + {d}) % 60) END")


# ------------------------------------------------------------ score table
# Events as a scored table: id event_id, score = value / 500 (in [0, 1)),
# label = purchase; two more deterministic scores for model comparisons.

def scores(spark, sf) -> DataFrame:
    e = T(spark, sf, "events")
    return e.select("event_id", (F.col("value") / 500.0).alias("score"),
                    F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                    (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("score_k"),
                    ((F.col("event_id") % 97) / 97.0).alias("score_id"))


SCORES_SQL = """scores AS (
  SELECT event_id, value / 500.0 AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 100.0 AS score_k,
         (event_id % 97) / 97.0 AS score_id
  FROM events)"""


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
