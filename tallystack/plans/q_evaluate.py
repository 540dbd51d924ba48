"""Evaluation queries on the score table (events: score = value / 500,
label = purchase, id = event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import clean, evaluate, explain, profile
from tallystack.plans.registry import query
from tallystack.plans.tables import SCORES_SQL, T, r6, scores

THR_SQL = "(SELECT avg(label) FROM scores)"
CLS_SQL = f"""{SCORES_SQL},
cls AS (SELECT event_id, label, CASE WHEN score > {THR_SQL} THEN 'ch_in' ELSE 'Noch_in' END AS pred,
          CASE WHEN label = 1 THEN 'ch_in' ELSE 'Noch_in' END AS obs FROM scores)"""


def classified(spark, sf):
    s = scores(spark, sf)
    thr = profile.overall_mean(s, "label").first()["mean"]
    s = clean.threshold_class(s, "score", thr, "pred")
    return s.withColumn("obs", F.when(F.col("label") == 1, "ch_in").otherwise("Noch_in"))


@query("overall_mean", f"WITH {SCORES_SQL} SELECT round(avg(label), 6) AS mean FROM scores")
def overall_mean(spark, sf):
    return profile.overall_mean(scores(spark, sf), "label").select(r6("mean").alias("mean"))


@query("threshold_class", f"WITH {CLS_SQL} SELECT event_id, pred FROM cls")
def threshold_class(spark, sf):
    return classified(spark, sf).select("event_id", "pred")


@query("is_correct", f"WITH {CLS_SQL} SELECT event_id, CAST(pred = obs AS INTEGER) AS correct FROM cls")
def is_correct(spark, sf):
    c = clean.is_correct(classified(spark, sf), "pred", "obs")
    return c.select("event_id", F.col("correct").cast("int").alias("correct"))


@query("pct_correct", f"WITH {CLS_SQL} SELECT round(100 * avg(CAST(pred = obs AS DOUBLE)), 6) AS pct_correct FROM cls")
def pct_correct(spark, sf):
    return evaluate.pct_correct(classified(spark, sf), "pred", "obs").select(r6("pct_correct").alias("pct_correct"))


@query("crosstab", f"WITH {CLS_SQL} SELECT pred, obs, count(*) AS n FROM cls GROUP BY pred, obs")
def crosstab(spark, sf):
    return profile.crosstab(classified(spark, sf), "pred", "obs")


def _cells(pos):
    return (f"count(CASE WHEN pred = '{pos}' AND obs = '{pos}' THEN 1 END) AS tp, "
            f"count(CASE WHEN pred <> '{pos}' AND obs = '{pos}' THEN 1 END) AS fn, "
            f"count(CASE WHEN pred = '{pos}' AND obs <> '{pos}' THEN 1 END) AS fp, "
            f"count(CASE WHEN pred <> '{pos}' AND obs <> '{pos}' THEN 1 END) AS tn, count(*) AS n")


@query("class_summary", f"""WITH {CLS_SQL}, c AS (SELECT {_cells('Noch_in')} FROM cls),
m AS (SELECT *, tp / (tp + fp) AS prec, tp / (tp + fn) AS rec FROM c)
SELECT round(tp / n, 6) AS TP, round(fn / n, 6) AS FN, round(fp / n, 6) AS FP, round(tn / n, 6) AS TN,
  round((tp + tn) / n, 6) AS Acc, round(prec, 6) AS Prec, round(rec, 6) AS Rec,
  round(2 * prec * rec / (prec + rec), 6) AS F1 FROM m""")
def class_summary(spark, sf):
    """Positive class = the first level, 'Noch_in', as in the reference."""
    c = evaluate.class_summary(classified(spark, sf), "pred", "obs", "Noch_in")
    return c.select(*[r6(x).alias(x) for x in c.columns])


@query("confusion_report", f"""WITH {CLS_SQL}, c AS (SELECT {_cells('ch_in')} FROM cls),
m AS (SELECT *, (tp + tn) / n AS acc, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe,
        tp / (tp + fn) AS sens, tn / (tn + fp) AS spec, tp / (tp + fp) AS ppv, tn / (tn + fn) AS npv FROM c)
SELECT round(acc, 6) AS accuracy, round((acc - pe) / (1 - pe), 6) AS kappa, round(sens, 6) AS sensitivity,
  round(spec, 6) AS specificity, round(ppv, 6) AS pos_pred_value, round(npv, 6) AS neg_pred_value,
  round((tp + fn) / n, 6) AS prevalence, round(tp / n, 6) AS detection_rate,
  round((tp + fp) / n, 6) AS detection_prevalence, round((sens + spec) / 2, 6) AS balanced_accuracy,
  round(2 * ppv * sens / (ppv + sens), 6) AS f1 FROM m""")
def confusion_report(spark, sf):
    c = evaluate.confusion_report(classified(spark, sf), "pred", "obs", "ch_in")
    return c.select(*[r6(x).alias(x) for x in c.columns])


def curve_sql(score: str, model: str | None = None) -> str:
    m = f"'{model}' AS model, " if model else ""
    return f"""SELECT {m}event_id, row_number() OVER w AS rank,
  round(row_number() OVER w / count(*) OVER (), 6) AS cum_x,
  round(sum(label) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(label) OVER (), 6) AS cum_y
FROM scores WINDOW w AS (ORDER BY {score} DESC, event_id)"""


@query("lift_curve", f"WITH {SCORES_SQL} {curve_sql('score')}")
def lift_curve(spark, sf):
    c = evaluate.lift_curve(scores(spark, sf), "score", "label", "event_id")
    return c.select("event_id", "rank", r6("cum_x").alias("cum_x"), r6("cum_y").alias("cum_y"))


def metrics_sql(score: str) -> str:
    return f"""(SELECT label, row_number() OVER w AS rk, count(*) OVER () AS n, sum(label) OVER () AS p,
    sum(label) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp
  FROM scores WINDOW w AS (ORDER BY {score} DESC, event_id))"""


def tdl_gini_sql(score: str) -> str:
    return f"""SELECT (sum(CASE WHEN rk <= floor(n * 0.1) THEN label ELSE 0 END) / floor(n * 0.1)) / (max(p) / max(n)) AS tdl,
  coalesce(sum(CASE WHEN rk < n THEN (cp / p - rk / n) / (1 - rk / n) END), 0) / max(n) AS gini
FROM {metrics_sql(score)} GROUP BY n, p"""


@query("top_decile_lift", f"WITH {SCORES_SQL} SELECT round(tdl, 6) AS tdl FROM ({tdl_gini_sql('score')})")
def top_decile_lift(spark, sf):
    return evaluate.top_decile_lift(scores(spark, sf), "score", "label", "event_id").select(r6("tdl").alias("tdl"))


@query("gini", f"WITH {SCORES_SQL} SELECT round(gini, 6) AS gini FROM ({tdl_gini_sql('score')})")
def gini(spark, sf):
    return evaluate.gini(scores(spark, sf), "score", "label", "event_id").select(r6("gini").alias("gini"))


def auc_sql(table: str, score: str, label: str) -> str:
    """Rank-sum (Mann-Whitney) form with mid-ranks for ties: independent of
    the cumulative form used on the Spark side."""
    return f"""(SELECT (sum(CASE WHEN {label} = 1 THEN rnk END) - sum({label}) * (sum({label}) + 1) / 2.0)
         / (sum({label}) * (count(*) - sum({label}))) AS auc
  FROM (SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rnk
        FROM {table}))"""


@query("roc_auc", f"WITH {SCORES_SQL} SELECT round(auc, 6) AS auc, round(auc * 100, 6) AS auc_pct FROM {auc_sql('scores', 'score', 'label')}")
def roc_auc(spark, sf):
    a = evaluate.roc_auc(scores(spark, sf), "score", "label")
    return a.select(r6("auc").alias("auc"), r6("auc_pct").alias("auc_pct"))


MODELS = {"value": "score", "props": "score_k", "id": "score_id"}


@query("lift_multi", f"WITH {SCORES_SQL} " + " UNION ALL ".join(
    f"({curve_sql(col, name)})" for name, col in MODELS.items()))
def lift_multi(spark, sf):
    c = evaluate.lift_multi(scores(spark, sf), MODELS, "label", "event_id")
    return c.select("model", "event_id", "rank", r6("cum_x").alias("cum_x"), r6("cum_y").alias("cum_y"))


@query("model_leaderboard", f"""WITH {SCORES_SQL}, thr AS (SELECT avg(label) AS t FROM scores),
lb AS ({' UNION ALL '.join(
    f"SELECT '{name}' AS model, tdl, gini, (SELECT 100 * avg(CAST((CASE WHEN {col} > (SELECT t FROM thr) THEN 1 ELSE 0 END) = label AS DOUBLE)) FROM scores) AS pct_correct FROM ({tdl_gini_sql(col)})"
    for name, col in MODELS.items())})
SELECT model, round(tdl, 6) AS tdl, round(gini, 6) AS gini, round(pct_correct, 6) AS pct_correct,
  round(tdl / max(tdl) OVER (), 6) AS tdl_rel, round(gini / max(gini) OVER (), 6) AS gini_rel FROM lb""")
def model_leaderboard(spark, sf):
    lb = evaluate.leaderboard(scores(spark, sf), MODELS, "label", "event_id")
    return lb.select("model", *[r6(c).alias(c) for c in ("tdl", "gini", "pct_correct", "tdl_rel", "gini_rel")])


IMP_FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("importance_auc", """WITH li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) """
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(greatest(auc, 1 - auc), 6) AS importance FROM "
                            + auc_sql("li", f, "y") for f in IMP_FEATS))
def importance_auc(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    imp = evaluate.importance_auc(li, list(IMP_FEATS), "y")
    return imp.select("feature", r6("importance").alias("importance"))


@query("shap_summary", """WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
lg AS (SELECT feature, phi FROM (
  SELECT 'l_quantity' AS feature, (l_quantity - avg(l_quantity) OVER ()) * 0.01 AS phi FROM li
  UNION ALL SELECT 'l_extendedprice', (l_extendedprice - avg(l_extendedprice) OVER ()) * 0.01 FROM li
  UNION ALL SELECT 'l_discount', (l_discount - avg(l_discount) OVER ()) * 0.01 FROM li
  UNION ALL SELECT 'l_tax', (l_tax - avg(l_tax) OVER ()) * 0.01 FROM li)),
s AS (SELECT feature, avg(abs(phi)) AS m FROM lg GROUP BY feature)
SELECT feature, round(m, 6) AS mean_abs_phi, CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS rank FROM s""")
def shap_summary(spark, sf):
    """A contribution table built from lineitem numerics: phi = (x - mean) *
    0.01, in long form (row, feature, phi); then the summary."""
    li = T(spark, sf, "lineitem")
    means = li.agg(*[F.avg(c).alias(c) for c in IMP_FEATS]).first()
    long = li.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(means[c])) * 0.01).alias("phi"))
        for c in IMP_FEATS])).alias("s")).select("s.feature", "s.phi")
    s = explain.shap_summary(long, 15)
    return s.select("feature", r6("mean_abs_phi").alias("mean_abs_phi"), "rank")
