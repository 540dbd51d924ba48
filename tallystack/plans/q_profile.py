"""Profiling, statistics and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import impute, profile
from tallystack.plans.registry import query
from tallystack.plans.tables import T, r6

PMISS_COLS = ("p_brand", "p_size", "p_type", "p_retailprice")

PMISS_SQL = """pm AS (SELECT p_partkey, p_name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS p_type,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice,
  CAST(NULL AS VARCHAR) AS p_comment FROM part)"""


def pmiss(spark, sf, with_comment=True):
    p = T(spark, sf, "part")
    k = F.col("p_partkey")
    out = p.select("p_partkey", "p_name",
                   *[F.when(k % m == 0, F.lit(None)).otherwise(F.col(c)).alias(c)
                     for c, m in zip(PMISS_COLS, (5, 7, 9, 11))])
    return out.withColumn("p_comment", F.lit(None).cast("string")) if with_comment else out


ALL7 = ("p_partkey", "p_name", "p_brand", "p_size", "p_type", "p_retailprice", "p_comment")


@query("profile_intro", f"""WITH {PMISS_SQL}
SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns,
  CAST((count(p_name) > 0)::INT + (count(p_brand) > 0)::INT + (count(p_type) > 0)::INT + (count(p_comment) > 0)::INT AS BIGINT) AS discrete_columns,
  CAST((count(p_partkey) > 0)::INT + (count(p_size) > 0)::INT + (count(p_retailprice) > 0)::INT AS BIGINT) AS continuous_columns,
  CAST({' + '.join(f'(count({c}) = 0)::INT' for c in ALL7)} AS BIGINT) AS all_missing_columns,
  CAST({' + '.join(f'(count(*) - count({c}))' for c in ALL7)} AS BIGINT) AS missing_cells,
  count(CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in ALL7)} THEN 1 END) AS complete_rows,
  count(*) * 7 AS total_cells
FROM pm""")
def profile_intro(spark, sf):
    return profile.profile_intro(pmiss(spark, sf))


@query("profile_missing", f"WITH {PMISS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_missing FROM pm" for c in ALL7))
def profile_missing(spark, sf):
    m = profile.profile_missing(pmiss(spark, sf))
    return m.select("feature", "n_missing", r6("pct_missing").alias("pct_missing"))


@query("missing_pattern", f"""WITH {PMISS_SQL}
SELECT {' || '.join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in PMISS_COLS)} AS pattern,
  {' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in PMISS_COLS)} AS n_missing_cols,
  count(*) AS n_rows
FROM pm GROUP BY 1, 2""")
def missing_pattern(spark, sf):
    return profile.missing_pattern(pmiss(spark, sf, False), list(PMISS_COLS))


NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("summary_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round_even(avg({c}), 3) AS mean, round_even(median({c}), 3) AS median, "
    f"round_even(stddev_samp({c}), 3) AS sd, round_even(min({c}), 3) AS min, round_even(max({c}), 3) AS max "
    f"FROM lineitem" for c in NUMS))
def summary_stats(spark, sf):
    return profile.summary_stats(T(spark, sf, "lineitem"), list(NUMS), 3, exact=True)


CORR_COLS = NUMS + ("l_revenue",)
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round_even(corr({a}, {b}), 2) AS r "
    f"FROM (SELECT *, l_extendedprice * (1 - l_discount) AS l_revenue FROM lineitem)"
    for a in CORR_COLS for b in CORR_COLS)


def _li_rev(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.withColumn("l_revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("corr_matrix", CORR_SQL)
def corr_matrix(spark, sf):
    return profile.corr_long(_li_rev(spark, sf), list(CORR_COLS), 2)


@query("strong_corr", f"""SELECT var1, var2, r, CAST(r > 0 AS INTEGER) AS positive, CAST(r < 0 AS INTEGER) AS negative
FROM ({CORR_SQL}) WHERE var1 <> var2 AND abs(r) > 0.5""")
def strong_corr(spark, sf):
    return profile.strong_corr(profile.corr_long(_li_rev(spark, sf), list(CORR_COLS), 2), 0.5)


IMP_SQL = """src AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
f AS (SELECT p_type, count(*) AS n FROM src WHERE p_type IS NOT NULL GROUP BY p_type),
cf AS (SELECT p_type, (sum(n) OVER (ORDER BY p_type) - n) / sum(n) OVER () AS lo,
              sum(n) OVER (ORDER BY p_type) / sum(n) OVER () AS hi FROM f),
reps AS (SELECT s.p_partkey, s.p_type, i.imp FROM src s, (SELECT unnest(range(1, 6)) AS imp) i),
uu AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '500', imp, 'p_type', p_partkey)), 1, 8))::BIGINT / 4294967296.0 AS u FROM reps),
done AS (SELECT uu.p_partkey, CAST(uu.imp AS INTEGER) AS imp, coalesce(uu.p_type, cf.p_type) AS p_type
         FROM uu LEFT JOIN cf ON uu.p_type IS NULL AND uu.u >= cf.lo AND uu.u < cf.hi)"""


def _imputed(spark, sf):
    p = T(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("p_type"))
    return impute.impute_marginal(p, ["p_type"], "p_partkey", m=5, seed=500)


@query("impute_marginal", f"WITH {IMP_SQL} SELECT p_partkey, imp, p_type FROM done")
def impute_marginal(spark, sf):
    return _imputed(spark, sf).select("p_partkey", "imp", "p_type")


@query("complete_k", f"WITH {IMP_SQL} SELECT p_partkey, p_type FROM done WHERE imp = 2")
def complete_k(spark, sf):
    return impute.complete_k(_imputed(spark, sf), 2).select("p_partkey", "p_type")


@query("impute_chained")
def impute_chained(spark, sf):
    """Chained equations on part with missing cells: p_size explained by
    type, brand and price (as the reference explains only one column by all
    others); the rest get marginal draws. Fifty sweeps, m = 5."""
    p = pmiss(spark, sf, False).drop("p_name")
    return impute.impute_chained(p, {"p_size": ["p_type", "p_brand", "p_retailprice"]}, "p_partkey",
                                 m=5, max_iter=50, seed=500)


@query("impute_chained_pmm")
def impute_chained_pmm(spark, sf):
    """The same chained imputation with predictive mean matching for the
    numeric target (5 donors)."""
    p = pmiss(spark, sf, False).drop("p_name")
    return impute.impute_chained(p, {"p_size": ["p_type", "p_brand", "p_retailprice"]}, "p_partkey",
                                 m=5, max_iter=50, seed=500, numeric_method="pmm", donors=5)


def _banded(spark, sf):
    """part with a four-level price range, a seventh of it missing."""
    k = F.col("p_partkey")
    band = F.concat(F.lit("R"), F.least(F.floor(F.col("p_retailprice") / 300), F.lit(4)).cast("string"))
    return T(spark, sf, "part").select("p_partkey", F.when(k % 7 == 0, None).otherwise(band).alias("price_range"),
                                       F.when(k % 9 == 0, None).otherwise(F.col("p_size")).alias("p_size"), "p_brand")


@query("impute_chained_category")
def impute_chained_category(spark, sf):
    """A categorical target explained by all others (the reference's only
    explained target is a price range)."""
    return impute.impute_chained(_banded(spark, sf), {"price_range": ["p_size", "p_brand"], "p_size": ["price_range"]},
                                 "p_partkey", m=2, max_iter=2, seed=500, categorical=["price_range", "p_brand"])


def _kept(done, before, cols):
    """Per copy: rows, cells still missing, observed cells that changed, and
    filled cells whose value was never observed."""
    b = before.select("p_partkey", *[F.col(c).alias(f"_{c}") for c in cols])
    j = done.join(b, "p_partkey")
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"),
                 F.count_if(F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c))).alias(f"{c}_changed"),
                 F.count_if(F.col(f"_{c}").isNull() & F.col(c).isNotNull()).alias(f"{c}_filled")]
    return j.groupBy("imp").agg(*aggs)


@query("impute_chained_invariants", f"""WITH {PMISS_SQL}, c AS (SELECT unnest(range(1, 6))::INTEGER AS imp)
SELECT imp, count(*) AS n, """ + ", ".join(f"""0::BIGINT AS {c}_missing, 0::BIGINT AS {c}_changed, count(*) - count({c}) AS {c}_filled"""
                                           for c in ("p_size", "p_type", "p_brand", "p_retailprice")) + " FROM pm, c GROUP BY imp")
def impute_chained_invariants(spark, sf):
    """What chained imputation must keep: every row and observed cell, and no gap left."""
    cols = ["p_size", "p_type", "p_brand", "p_retailprice"]
    return _kept(impute_chained(spark, sf), pmiss(spark, sf, False), cols)


@query("impute_category_invariants", """WITH c AS (SELECT unnest(range(1, 3))::INTEGER AS imp)
SELECT imp, count(*) AS n, 0::BIGINT AS price_range_missing, 0::BIGINT AS price_range_changed,
       count(*) FILTER (p_partkey % 7 = 0) AS price_range_filled, 0::BIGINT AS p_size_missing, 0::BIGINT AS p_size_changed,
       count(*) FILTER (p_partkey % 9 = 0) AS p_size_filled FROM part, c GROUP BY imp""")
def impute_category_invariants(spark, sf):
    return _kept(impute_chained_category(spark, sf), _banded(spark, sf), ["price_range", "p_size"])
