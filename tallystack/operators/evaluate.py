"""Classifier evaluation on a scored table (id, label 0/1, score).

Order-dependent metrics (lift curve, top-decile lift, Gini, cumulative hits)
use the two-phase global order of ``ordered.py``: rows sorted by descending
score, equal scores in ascending id order. AUC groups by distinct score
first, so ties never need an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystack.operators.ordered import ordered_prefix


def _y(label, positive=1):
    return F.when(F.col(label) == F.lit(positive), 1).otherwise(0)


def rank_by_score(df: DataFrame, score: str, id_col: str, name: str = "rank") -> DataFrame:
    return ordered_prefix(df, score, id_col, True, rank_col=name, total_col=None)


def cumulative_hits(df: DataFrame, score: str, label: str, id_col: str, positive=1) -> DataFrame:
    """Rank and running count of positives in descending score order."""
    return ordered_prefix(df, score, id_col, True, sums={"cum_hits": _y(label, positive)},
                          total_col=None).drop("cum_hits_total")


def lift_curve(df: DataFrame, score: str, label: str, id_col: str, positive=1) -> DataFrame:
    """Per row: rank, cumulative share of rows (cum_x) and of positives (cum_y)."""
    o = ordered_prefix(df, score, id_col, True, sums={"cum_pos": _y(label, positive)})
    return (o.withColumn("cum_x", F.col("rank") / F.col("n_total"))
             .withColumn("cum_y", F.try_divide(F.col("cum_pos"), F.col("cum_pos_total"))))


def lift_metrics(df: DataFrame, score: str, label: str, id_col: str, positive=1) -> DataFrame:
    """One row: n, positives, top-decile lift and Gini.

    TDL = share of positives among the first floor(0.1 n) rows / overall
    share (null when n < 10 or there is no positive).
    Gini = sum over rows of (cum_y - cum_x) / (1 - cum_x), the undefined last
    term left out, divided by n (0 when there is no positive, as the
    reference's NA-removing sum gives)."""
    c = lift_curve(df, score, label, id_col, positive)
    n, p = F.col("n_total"), F.col("cum_pos_total")
    cut = F.floor(n * 0.1)
    y = _y(label, positive)
    per = c.select(
        n.alias("n"), p.alias("p"), cut.alias("cut"),
        F.when(F.col("rank") <= cut, y).otherwise(0).alias("top_hit"),
        F.try_divide(F.col("cum_y") - F.col("cum_x"), 1 - F.col("cum_x")).alias("g"))
    agg = per.groupBy("n", "p", "cut").agg(F.sum("top_hit").alias("top_hits"),
                                           F.sum("g").alias("g_sum"))
    tdl = F.try_divide(F.try_divide(F.col("top_hits"), F.col("cut")), F.try_divide(F.col("p"), F.col("n")))
    return agg.select(F.col("n").cast("long").alias("n"), F.col("p").cast("long").alias("positives"),
                      F.when(F.col("cut") > 0, tdl).alias("tdl"),
                      (F.coalesce(F.col("g_sum"), F.lit(0.0)) / F.col("n")).alias("gini"))


def top_decile_lift(df, score, label, id_col, positive=1) -> DataFrame:
    return lift_metrics(df, score, label, id_col, positive).select("tdl")


def gini(df, score, label, id_col, positive=1) -> DataFrame:
    return lift_metrics(df, score, label, id_col, positive).select("gini")


def roc_points(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """ROC points per distinct score (threshold = score, predict positive
    when score >= threshold): tpr, fpr, plus the per-score counts. A row
    without a score cannot be ranked and is left out, as ROC packages do."""
    y = _y(label, positive)
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    o = ordered_prefix(per, "threshold", "threshold", True,
                       sums={"tp": F.col("pos"), "fp": F.col("neg")}, total_col=None)
    return (o.withColumn("tpr", F.try_divide(F.col("tp"), F.col("tp_total")))
             .withColumn("fpr", F.try_divide(F.col("fp"), F.col("fp_total"))))


def roc_auc(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """AUC = P(score of a positive > score of a negative) + half the tie
    probability; null when only one class occurs. One row: auc, auc_pct."""
    o = roc_points(df, score, label, positive)
    # negatives strictly below this score = all negatives - negatives at or above
    below = F.col("fp_total") - F.col("fp")
    per = o.select((F.col("pos") * below + 0.5 * F.col("pos") * F.col("neg")).alias("w"),
                   F.col("tp_total").alias("P"), F.col("fp_total").alias("N"))
    a = per.groupBy("P", "N").agg(F.sum("w").alias("w"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("w") / (F.col("P") * F.col("N")))
    return a.select(auc.alias("auc"), (auc * 100).alias("auc_pct"))


def class_summary(df: DataFrame, pred: str, obs: str, positive) -> DataFrame:
    """Cell shares, accuracy, precision, recall and F1 of class ``positive``."""
    p, o, pos = F.col(pred), F.col(obs), F.lit(positive)
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if((p == pos) & (o == pos)).alias("tp"),
               F.count_if((p != pos) & (o == pos)).alias("fn"),
               F.count_if((p == pos) & (o != pos)).alias("fp"),
               F.count_if((p != pos) & (o != pos)).alias("tn"))
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*[(F.col(k) / F.col("n")).alias(k.upper()) for k in ("tp", "fn", "fp", "tn")],
                    ((F.col("tp") + F.col("tn")) / F.col("n")).alias("Acc"),
                    prec.alias("Prec"), rec.alias("Rec"),
                    F.try_divide(2 * prec * rec, prec + rec).alias("F1"))


def confusion_report(df: DataFrame, pred: str, obs: str, positive) -> DataFrame:
    """Accuracy, kappa, sensitivity, specificity, predictive values,
    prevalence, detection rate, balanced accuracy, F1 (positive class given)."""
    p, o, pos = F.col(pred), F.col(obs), F.lit(positive)
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if((p == pos) & (o == pos)).alias("tp"),
               F.count_if((p != pos) & (o == pos)).alias("fn"),
               F.count_if((p == pos) & (o != pos)).alias("fp"),
               F.count_if((p != pos) & (o != pos)).alias("tn"))
    tp, fn, fp, tn, n = (F.col(k) for k in ("tp", "fn", "fp", "tn", "n"))
    acc = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    ppv, npv = F.try_divide(tp, tp + fp), F.try_divide(tn, tn + fn)
    return c.select(acc.alias("accuracy"), F.try_divide(acc - pe, 1 - pe).alias("kappa"),
                    sens.alias("sensitivity"), spec.alias("specificity"),
                    ppv.alias("pos_pred_value"), npv.alias("neg_pred_value"),
                    ((tp + fn) / n).alias("prevalence"), (tp / n).alias("detection_rate"),
                    ((tp + fp) / n).alias("detection_prevalence"),
                    ((sens + spec) / 2).alias("balanced_accuracy"),
                    F.try_divide(2 * ppv * sens, ppv + sens).alias("f1"))


def pct_correct(df: DataFrame, pred: str, obs: str) -> DataFrame:
    return df.agg((F.avg((F.col(pred) == F.col(obs)).cast("double")) * 100).alias("pct_correct"))


def _long_scores(df: DataFrame, scores: dict, label: str, id_col: str, positive=1) -> DataFrame:
    """(g, model, id, y, score): one row per (row, model), g = model index."""
    return df.select(id_col, _y(label, positive).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("g"), F.lit(name).alias("model"), F.col(c).cast("double").alias("score"))
        for i, (name, c) in enumerate(scores.items())])).alias("x")).select("x.g", "x.model", id_col, "_y", "x.score")


def lift_multi(df: DataFrame, scores: dict, label: str, id_col: str, positive=1) -> DataFrame:
    """Lift curves of several models in one long table (model, id, rank,
    cum_x, cum_y). ``scores`` = {model name: score column}; all models are
    ordered in one pass (descending score, then id, within each model)."""
    from tallystack.operators.ordered import grouped_prefix
    long = _long_scores(df, scores, label, id_col, positive)
    o = grouped_prefix(long, "g", "score", [id_col], descending=True, sums={"cum_pos": F.col("_y")})
    return o.select("model", id_col, "rank", (F.col("rank") / F.col("n_group")).alias("cum_x"),
                    F.try_divide(F.col("cum_pos"), F.col("cum_pos_total")).alias("cum_y"))


def leaderboard(df: DataFrame, scores: dict, label: str, id_col: str, threshold=None,
                positive=1, seconds: dict | None = None) -> DataFrame:
    """TDL, Gini and percent correct per model, TDL and Gini also divided by
    their maximum over models. ``threshold`` (default: mean label) turns a
    score into a class: score > threshold. All models in one ordered pass."""
    y = _y(label, positive)
    if threshold is None:
        threshold = df.agg(F.avg(y)).first()[0]
    long = _long_scores(df, scores, label, id_col, positive)
    return _board(long, id_col, threshold, seconds)


def _board(long: DataFrame, id_col: str, threshold, seconds) -> DataFrame:
    """(g, model, id, _y, score) rows -> one leaderboard row per model."""
    from tallystack.operators.ordered import grouped_prefix
    o = grouped_prefix(long, "g", "score", [id_col], descending=True, sums={"cum_pos": F.col("_y")})
    n, p = F.col("n_group"), F.col("cum_pos_total")
    cx, cy = F.col("rank") / n, F.try_divide(F.col("cum_pos"), p)
    cut = F.floor(n * 0.1)
    per = o.select("model", n.alias("n"), p.alias("p"), cut.alias("cut"),
                   F.when(F.col("rank") <= cut, F.col("_y")).otherwise(0).alias("top_hit"),
                   F.try_divide(cy - cx, 1 - cx).alias("gg"),
                   (F.when(F.col("score") > F.lit(threshold), 1).otherwise(0) == F.col("_y")).cast("double").alias("ok"))
    a = per.groupBy("model", "n", "p", "cut").agg(F.sum("top_hit").alias("th"), F.sum("gg").alias("gs"),
                                                  F.avg("ok").alias("acc"))
    tdl = F.try_divide(F.try_divide(F.col("th"), F.col("cut")), F.try_divide(F.col("p"), F.col("n")))
    rows = a.select("model", F.when(F.col("cut") > 0, tdl).alias("tdl"),
                    (F.coalesce(F.col("gs"), F.lit(0.0)) / F.col("n")).alias("gini"),
                    (F.col("acc") * 100).alias("pct_correct"))
    if seconds is not None:
        secs = F.create_map(*[x for k, v in seconds.items() for x in (F.lit(k), F.lit(float(v)))])
        rows = rows.withColumn("seconds", secs[F.col("model")])
    w = Window.partitionBy()  # one row per model
    return (rows.withColumn("tdl_rel", F.col("tdl") / F.max("tdl").over(w))
                .withColumn("gini_rel", F.col("gini") / F.max("gini").over(w)))


def timed(build):
    """(DataFrame, seconds): run ``build()`` and execute its result once into
    the no-op sink, timing both (fit + score, as the reference times)."""
    import time
    t0 = time.perf_counter()
    df = build()
    df.write.format("noop").mode("overwrite").save()
    return df, time.perf_counter() - t0


def leaderboard_scored(scored: dict, threshold: float, seconds: dict | None = None,
                       id_col: str = "id", label: str = "label", score: str = "score") -> DataFrame:
    """Leaderboard from one scored table per model ({name: (id, label,
    score)}): TDL, Gini, percent correct at ``threshold``, seconds, and TDL
    and Gini relative to their best model; all models in one ordered pass."""
    parts = [d.select(F.lit(i).alias("g"), F.lit(name).alias("model"), id_col,
                      _y(label).alias("_y"), F.col(score).cast("double").alias("score"))
             for i, (name, d) in enumerate(scored.items())]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return _board(long, id_col, threshold, seconds)


def importance_auc(df: DataFrame, features, label: str, positive=1) -> DataFrame:
    """Per feature: AUC of the feature alone as a score, folded so that a
    reversed feature counts as informative: max(auc, 1 - auc). All features
    in one pass: (feature, value) counts of positives and negatives, ordered
    within each feature by ``grouped_prefix``."""
    from tallystack.operators.ordered import grouped_prefix
    y = _y(label, positive)
    long = df.select(y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("g"), F.col(f).cast("double").alias("s")) for i, f in enumerate(features)]))
        .alias("x")).select("x.g", "x.s", "_y").where(F.col("s").isNotNull())
    from tallystack.session import checkpoint
    # the aggregate is read by three jobs (group stats, quantiles, result): written once
    per = checkpoint(long.groupBy("g", "s").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")))
    o = grouped_prefix(per, "g", "s", sums={"cneg": F.col("neg")})
    below = F.col("cneg") - F.col("neg")        # negatives with a strictly smaller value
    a = o.groupBy("g").agg(F.sum(F.col("pos") * below + 0.5 * F.col("pos") * F.col("neg")).alias("w"),
                           F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("w") / (F.col("P") * F.col("N")))
    names = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(i), F.lit(f))])
    return a.select(names[F.col("g")].alias("feature"), F.greatest(auc, 1 - auc).alias("importance"))


def top_n(df: DataFrame, col: str, n: int, descending: bool = True) -> DataFrame:
    """Rows whose value is among the n largest (ties kept, like rank() <= n).
    The n-th value comes from a distributed top-k (no global window)."""
    order = F.col(col).desc() if descending else F.col(col).asc()
    kth = df.select(col).where(F.col(col).isNotNull()).orderBy(order).limit(n).agg(
        (F.min if descending else F.max)(col).alias("k")).first()["k"]
    if kth is None:
        return df.limit(0)
    return df.filter(F.col(col) >= F.lit(kth) if descending else F.col(col) <= F.lit(kth))


def head_n(df: DataFrame, order, n: int) -> DataFrame:
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)
