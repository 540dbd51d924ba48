"""pyspark.ml classifiers with the reference's settings, a radial-kernel SVM
approximated by random Fourier features, and the GLM coefficient table."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.operators.models import forests, hist_trees, radial
from tallystack.operators.models.common import feature_stages, fit_score
from tallystack.operators.prep import FeatureSpec


def model_logit(spec, train, evaluate, id_col, **params):
    est = LogisticRegression(regParam=params.get("reg", 0.0), maxIter=params.get("max_iter", 100))
    return fit_score(est, spec, train, evaluate, id_col)


def model_mlp(spec, train, evaluate, id_col, hidden=(4, 2, 6), seed=1, **params):
    """Hidden layers 4-2-6 as tuned in the reference; scaled inputs."""
    n_in = _n_features(spec, train)
    est = MultilayerPerceptronClassifier(layers=[n_in, *hidden, 2], seed=seed,
                                         maxIter=params.get("max_iter", 200))
    return fit_score(est, spec, train, evaluate, id_col, scale=True)


def _as_arrays(spec, train, evaluate, id_col):
    """Both tables as (id, label, x): features dummy coded on the training table."""
    prep = Pipeline(stages=feature_stages(spec)).fit(train)

    def of(d):
        return prep.transform(d).select(id_col, F.col(spec.label).alias("label"), vector_to_array("features").alias("x"))
    return of(train), of(evaluate), prep


def model_tree(spec, train, evaluate, id_col, max_depth=5, mincriterion=0.873003, **params):
    """Conditional inference tree: permutation tests choose the variable and
    decide when to stop. Returns (scored, model, seconds)."""
    t0 = time.perf_counter()
    tr, ev, _prep = _as_arrays(spec, train, evaluate, id_col)
    model = hist_trees.fit_inferred(tr, id_col, "label", "x", depth=max_depth, mincriterion=mincriterion, **params)
    return hist_trees.score(model, ev, id_col, "label", "x"), model, time.perf_counter() - t0


def model_tree_impurity(spec, train, evaluate, id_col, max_depth=5, min_info_gain=0.0, seed=1, **params):
    """Impurity splits with a depth limit."""
    est = DecisionTreeClassifier(maxDepth=max_depth, minInfoGain=min_info_gain, seed=seed)
    return fit_score(est, spec, train, evaluate, id_col)


#: rows times trees up to which ``pyspark.ml`` may cache a draw of every row for every tree
FOREST_DRAWS = 1 << 26


def _forest(spec, train, evaluate, id_col, forest):
    """A forest grown from grouped counts. Returns (scored, model, seconds)."""
    t0 = time.perf_counter()
    tr, ev, _prep = _as_arrays(spec, train, evaluate, id_col)
    model, = forests.fit_forests(tr, id_col, "label", "x", [forest])
    return hist_trees.score(model, ev, id_col, "label", "x"), model, time.perf_counter() - t0


def model_bagging(spec, train, evaluate, id_col, n_trees=25, seed=1, **params):
    """Bagged trees: bootstrap samples, every feature considered at each split;
    beyond ``FOREST_DRAWS`` grown from grouped counts (``forests``)."""
    if train.count() * n_trees > FOREST_DRAWS:
        return _forest(spec, train, evaluate, id_col, forests.Forest(n_trees, None, params.get("max_depth", 10), seed=seed))
    est = RandomForestClassifier(numTrees=n_trees, featureSubsetStrategy="all", bootstrap=True,
                                 maxDepth=params.get("max_depth", 10), seed=seed)
    return fit_score(est, spec, train, evaluate, id_col)


def model_rf(spec, train, evaluate, id_col, mtry=9, n_trees=100, seed=1, **params):
    """Random forest with ``mtry`` features per node; beyond ``FOREST_DRAWS``
    grown from grouped counts (``forests``)."""
    if train.count() * n_trees > FOREST_DRAWS:
        return _forest(spec, train, evaluate, id_col, forests.Forest(n_trees, mtry, params.get("max_depth", 10), seed=seed))
    est = RandomForestClassifier(numTrees=n_trees, featureSubsetStrategy=str(mtry),
                                 maxDepth=params.get("max_depth", 10), seed=seed)
    return fit_score(est, spec, train, evaluate, id_col)


def boosting_estimator(rounds=73, depth=3, eta=0.243378, colsample=0.6703593, min_child=4,
                       subsample=0.9718927, seed=12345):
    """First-order gradient boosting on logistic loss; the column share is
    applied per split (per tree in the reference's library)."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=eta,
                         featureSubsetStrategy=str(colsample), minInstancesPerNode=min_child,
                         subsamplingRate=subsample, seed=seed)


def model_boosting(spec, train, evaluate, id_col, seed=12345, **params):
    """Second-order boosting with the reference's settings: gamma, hessian
    child weight, column share per tree, row share per round."""
    t0 = time.perf_counter()
    tr, ev, _prep = _as_arrays(spec, train, evaluate, id_col)
    model = hist_trees.fit_boosted(tr, id_col, "label", "x", seed=seed, **params)
    return hist_trees.score(model, ev, id_col, "label", "x"), model, time.perf_counter() - t0


def model_boosting_first_order(spec, train, evaluate, id_col, seed=12345, **params):
    """Gradient boosting of ``pyspark.ml``; its model is what the tree table,
    SHAP and model files read."""
    return fit_score(boosting_estimator(seed=seed, **params), spec, train, evaluate, id_col)


def _n_features(spec: FeatureSpec, train: DataFrame) -> int:
    m = Pipeline(stages=feature_stages(spec)).fit(train)
    return len(m.transform(train.limit(1)).first()["features"])


#: numbers (rows x Fourier features) up to which ``LinearSVC`` may cache them
FEATURE_CELLS = 1 << 26


def model_svm_rbf(spec, train, evaluate, id_col, sigma=1.0, C=0.01347207, n_features=200,
                  seed=1, **params):
    """Radial-kernel SVM, k(x, y) = exp(-sigma |x - y|^2), approximated with
    random Fourier features (Rahimi & Recht 2007): z(x) = sqrt(2/D) cos(Wx + b),
    W ~ N(0, 2 sigma), b ~ U(0, 2 pi); a linear SVM with cost C on z, then a
    logistic (Platt) calibration of its margin on the training table.
    Inputs are min-max scaled. The draw of W, b is D x p numbers. Beyond
    ``FEATURE_CELLS`` numbers the features are made slice by slice in every pass
    (``radial``) instead of being cached; penalty and loss are the same."""
    t0 = time.perf_counter()
    from tallystack.session import ship_package
    ship_package(train.sparkSession)
    prep = Pipeline(stages=feature_stages(spec, scale=True)).fit(train)
    tr = prep.transform(train).withColumn("_x", vector_to_array("features"))
    ev = prep.transform(evaluate).withColumn("_x", vector_to_array("features"))
    p = len(tr.select("_x").first()["_x"])
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * sigma), size=(n_features, p))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    lab = F.col(spec.label).cast("double")
    n = train.count()
    if n * n_features > FEATURE_CELLS:
        table = radial.packed(tr, spec.label, "_x")
        svm, = radial.fit(table, W, b, [radial.Machine(1.0 / (C * n))], params.get("max_iter", 100))
        m = radial.margin(W, b, svm)("_x")
        to_margin = lambda d: d.select(id_col, lab.alias("label"), m.alias("v")).select(id_col, "label", array_to_vector(F.array("v")).alias("m"))
        platt = LogisticRegression(featuresCol="m", labelCol="label").fit(to_margin(tr))
        scored = platt.transform(to_margin(ev)).select(id_col, "label", vector_to_array("probability")[1].alias("score"))
        return scored, (prep, svm, platt), time.perf_counter() - t0
    z = fourier_features(W, b)(F.col("_x"))
    tr = tr.select(id_col, lab.alias("label"), array_to_vector(z).alias("z"))
    ev = ev.select(id_col, lab.alias("label"), array_to_vector(z).alias("z"))
    svm = LinearSVC(featuresCol="z", labelCol="label", regParam=1.0 / (C * max(n, 1)),
                    maxIter=params.get("max_iter", 100)).fit(tr)
    margin = lambda d: svm.transform(d).select(id_col, "label", array_to_vector(
        F.array(vector_to_array("rawPrediction")[1])).alias("m"))
    platt = LogisticRegression(featuresCol="m", labelCol="label").fit(margin(tr))
    scored = platt.transform(margin(ev)).select(id_col, "label", vector_to_array("probability")[1].alias("score"))
    return scored, (prep, svm, platt), time.perf_counter() - t0


def fourier_features(W, b):
    """Arrow-batched projection z(x) = sqrt(2/D) cos(W x + b): one numpy
    matrix product per batch (the projection matrix is D x p numbers)."""
    from pyspark.sql.functions import pandas_udf
    scale = math.sqrt(2.0 / W.shape[0])

    @pandas_udf("array<double>")
    def rff(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        X = np.vstack(x.to_numpy())
        Z = scale * np.cos(X @ W.T + b)
        return pd.Series(list(Z))
    return rff


def glm_table(spec: FeatureSpec, df: DataFrame):
    """Binomial logit fit with the coefficient table (term, estimate,
    std_error, z_value, p_value) and the fitted pipeline. Terms are named
    from the assembler metadata; categorical terms are 'col_level'."""
    stages = feature_stages(spec)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol="_y", maxIter=50)
    model = Pipeline(stages=stages + [glm]).fit(df.withColumn("_y", F.col(spec.label).cast("double")))
    g = model.stages[-1]
    names = feature_names(model.transform(df.limit(1)), "features")
    s = g.summary
    ses, zs, ps = s.coefficientStandardErrors, s.tValues, s.pValues
    est = list(g.coefficients) + [g.intercept]
    terms = names + ["(Intercept)"]
    rows = [(t, float(e), float(se), float(z), float(p)) for t, e, se, z, p in zip(terms, est, ses, zs, ps)]
    tab = df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, z_value double, p_value double")
    return tab, model


def feature_names(df: DataFrame, col: str = "features"):
    """Names of the slots of an assembled vector from its ML attributes."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for kind in ("numeric", "binary", "nominal"):
        attrs += meta.get("attrs", {}).get(kind, [])
    n = meta.get("num_attrs", len(attrs))
    names = [f"f{i}" for i in range(n)]
    for a in attrs:
        names[a["idx"]] = a["name"].replace("__v_", "_").replace("__i", "")
    return names
