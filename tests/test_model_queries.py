"""Properties of the registered model, tuning and explanation queries (no
SQL twin), on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL

Q = E.queries()
SCORED = ["model_logit", "model_mlp", "model_tree", "model_bagging", "model_boosting", "model_rf",
          "model_svm_rbf"]


@pytest.fixture(scope="module")
def n_eval(spark):
    from tallystack.plans import q_models
    _, ev = q_models.split(spark, SF_SMALL)
    return ev.count()


@pytest.mark.parametrize("name", SCORED)
def test_scores_are_probabilities_one_per_eval_row(spark, name, n_eval):
    df = Q[name](spark, SF_SMALL)
    r = df.agg(F.count("*"), F.countDistinct("id"), F.min("score"), F.max("score")).first()
    assert r[0] == r[1] == n_eval and 0.0 <= r[2] <= r[3] <= 1.0


def test_shap_query_adds_up_to_margin(spark):
    from pyspark.ml.functions import vector_to_array
    from tallystack.plans import q_models
    _, ev, _, model = q_models.boosted(spark, SF_SMALL)
    sh = Q["shap_tree"](spark, SF_SMALL)
    tot = sh.groupBy("id").agg((F.sum("phi") + F.first("base")).alias("t"))
    m = model.transform(ev).select("id", vector_to_array("rawPrediction")[1].alias("m"))
    diff = tot.join(m, "id").agg(F.max(F.abs(F.col("t") - F.col("m")))).first()[0]
    assert diff < 1e-6


def test_tuning_tables_rank_grid_points(spark):
    t = Q["tuning_table"](spark, SF_SMALL).collect()
    assert len(t) == 3 and min(r["rank"] for r in t) == 1


def test_glm_vif_and_importance(spark):
    glm = {r["term"] for r in Q["model_glm_binomial"](spark, SF_SMALL).collect()}
    assert "(Intercept)" in glm and "reach" in glm
    vif = Q["vif"](spark, SF_SMALL).collect()
    assert all(r["gvif"] >= 1 - 1e-6 for r in vif)
    imp = Q["importance_model"](spark, SF_SMALL).collect()
    assert 1 <= len(imp) and all(r["gain"] >= 0 for r in imp)


def test_tree_dump_has_root(spark):
    nodes = Q["tree_dump"](spark, SF_SMALL).collect()
    assert any(r["node"] == 0 for r in nodes) and all(r["tree"] == 0 for r in nodes)


def test_model_sink_round_trip_scores(spark, n_eval):
    s = Q["model_sink"](spark, SF_SMALL)
    assert s.count() == n_eval


def test_smote_and_sentiment(spark):
    sm = Q["oversample_smote"](spark, SF_SMALL)
    assert sm.filter("synthetic = 1").count() > 0
    ts = Q["text_sentiment"](spark, SF_SMALL)
    assert ts.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_model_comparison_has_nine_families(spark):
    lb = Q["model_comparison"](spark, SF_SMALL).collect()
    assert len(lb) == 9 and max(r["tdl_rel"] for r in lb if r["tdl_rel"] is not None) == pytest.approx(1.0)


def test_naive_bayes_tuning_and_radial_grid(spark):
    t = Q["tune_naive_bayes"](spark, SF_SMALL).collect()
    assert len(t) == 9 and min(r["rank"] for r in t) == 1 and all(r["metric"] is None or 0 <= r["metric"] <= 1 for r in t)
    g = Q["auto_grid"](spark, SF_SMALL).collect()
    assert [r["cost"] for r in g] == [0.25, 0.5, 1.0] and all(r["sigma"] > 0 for r in g)
