"""Split, oversampling, scaling and class balance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import prep, profile
from tallystack.plans.registry import query
from tallystack.plans.tables import T, r6

U_SQL = "('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 8))::BIGINT / 4294967296.0"


@query("shuffle_split", f"""SELECT c_custkey,
  CASE WHEN row_number() OVER (ORDER BY {U_SQL.format(seed=66, key='c_custkey')}, c_custkey)
            <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'eval' END AS split
FROM customer""")
def shuffle_split(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey")
    return prep.shuffle_split(c, "c_custkey", 0.75, 66)


@query("oversample_random", f"""WITH c AS (SELECT quality, count(*) AS m FROM labels GROUP BY quality),
mx AS (SELECT max(m) AS mm FROM c),
r AS (SELECT l.doc_id, l.quality, c.m,
        row_number() OVER (PARTITION BY l.quality ORDER BY {U_SQL.format(seed=1, key='l.doc_id')}, l.doc_id) AS wr
      FROM labels l JOIN c ON l.quality = c.quality)
SELECT r.doc_id, r.quality, CAST(g.copy AS INTEGER) AS copy
FROM r, mx, LATERAL (SELECT unnest(range(0, mx.mm // r.m + CASE WHEN r.wr <= mx.mm % r.m THEN 1 ELSE 0 END)) AS copy) g""")
def oversample_random(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    return prep.oversample(lab, "quality", "doc_id", seed=1).select("doc_id", "quality", "copy")


@query("class_balance", """SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labels GROUP BY quality""")
def class_balance(spark, sf):
    b = profile.class_balance(T(spark, sf, "labels"), "quality")
    return b.select("quality", "n", r6("share").alias("share"))


MM_COLS = ("l_quantity", "l_extendedprice", "l_discount")


@query("minmax_scale", "WITH tr AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in MM_COLS) + " FROM lineitem WHERE l_orderkey % 4 <> 0) "
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - mn_{c}) / (mx_{c} - mn_{c}), 6) AS {c}" for c in MM_COLS)
    + " FROM lineitem, tr WHERE l_orderkey % 4 = 0")
def minmax_scale(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *MM_COLS)
    train, ev = li.filter(F.col("l_orderkey") % 4 != 0), li.filter(F.col("l_orderkey") % 4 == 0)
    _, ev_s = prep.minmax(train, ev, list(MM_COLS), fit_on="train")
    return ev_s.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in MM_COLS])
