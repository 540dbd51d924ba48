"""Edge frames for relational, feature, profiling and imputation operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallystack.operators import extract, features, impute, profile, relate


def test_join_suffixes_and_renamed_key(spark):
    a = spark.createDataFrame([(1, "a", 1.0)], "k int, name string, v double")
    b = spark.createDataFrame([(1, "b", 2.0)], "kk int, name string, v double")
    j = relate.join_on(a, b, {"k": "kk"}, "inner")
    assert sorted(j.columns) == ["k", "name_x", "name_y", "v_x", "v_y"]
    assert j.first()["name_y"] == "b"


def test_outer_chain_keeps_all_keys(spark):
    t1 = spark.createDataFrame([(1, 5)], "k int, a int")
    t2 = spark.createDataFrame([(2, 6)], "k int, b int")
    t3 = spark.createDataFrame([(1, 7), (3, 8)], "k int, c int")
    out = {r["k"]: (r["a"], r["b"], r["c"]) for r in relate.outer_chain([t1, t2, t3], ["k"]).collect()}
    assert out == {1: (5, None, 7), 2: (None, 6, None), 3: (None, None, 8)}


def test_sentiment_share_rounding_and_absence(spark):
    rows = ([("a", "POSITIVE", None)] * 1 + [("a", "NEGATIVE", None)] * 7 +
            [("b", None, None)] + [("c", None, "NEGATIVE")])
    df = spark.createDataFrame(rows, "k string, r string, t string")
    out = {r["k"]: (r["share_positive_feedback"], r["share_negative_feedback"])
           for r in features.sentiment_share(df, "k", "r", "t").collect()}
    assert out == {"a": (0.12, 0.88), "c": (0.0, 1.0)}        # 1/8 = 0.125 -> 0.12; b absent


def test_daily_grid_is_dense(spark):
    ts = [(1, dt.datetime(2024, 1, 1, 10), "purchase"), (1, dt.datetime(2024, 1, 3, 9), "view"),
          (2, dt.datetime(2024, 1, 2, 8), "purchase")]
    ev = spark.createDataFrame(ts, "u long, ts timestamp_ntz, t string")
    g = extract.daily_grid(ev, "u", "ts", F.col("t") == "purchase", count_name="n", flag="f")
    got = sorted((r["u"], str(r["day"]), r["f"]) for r in g.collect())
    assert got == [(1, "2024-01-01", 1), (1, "2024-01-02", 0), (1, "2024-01-03", 0),
                   (2, "2024-01-01", 0), (2, "2024-01-02", 1), (2, "2024-01-03", 0)]


def test_cumulative_max_and_sum(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 5)], "k int, d int, v int")
    s = extract.cumulative(df, "k", "d", "v", "sum", "s")
    m = extract.cumulative(s, "k", "d", "v", "max", "m")
    assert [(r["s"], r["m"]) for r in m.orderBy("d").collect()] == [(3, 3), (4, 3), (9, 5)]


@pytest.mark.parametrize("vals,med", [([3, 1, 2], 2.0), ([4, 1, 3, 2], 2.5), ([5, 5, 5, 1], 5.0)])
def test_exact_median(spark, vals, med):
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    assert profile.exact_median(df, "x").first()["median"] == med


def test_profile_intro_counts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None)], "i int, s string, z string")
    r = profile.profile_intro(df).first()
    assert (r["rows"], r["columns"], r["discrete_columns"], r["continuous_columns"],
            r["all_missing_columns"], r["missing_cells"], r["complete_rows"]) == (2, 3, 1, 1, 1, 3, 0)


def test_missing_pattern(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    got = {r["pattern"]: r["n_rows"] for r in profile.missing_pattern(df).collect()}
    assert got == {"10": 1, "00": 1, "11": 1}


def test_strict_entity_means(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 4.0)], "k int, v double")
    got = {r["k"]: r["m"] for r in profile.entity_means(df, "k", ["v"], True, ["m"]).collect()}
    assert got == {1: None, 2: 4.0}


def test_impute_chained_changes_only_missing(spark):
    rows = [(i, float(i % 10) if i % 6 else None, "x" if i % 2 else "y", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, c string, b double")
    out = impute.impute_chained(df, {"a": ["c", "b"]}, "k", m=2, max_iter=1, seed=1)
    assert out.count() == 600 and out.filter(F.col("a").isNull()).count() == 0
    orig = {r[0]: r[1] for r in rows}
    for r in out.collect():
        if orig[r["k"]] is not None:
            assert r["a"] == orig[r["k"]]


def test_assemble_default_and_parity(spark):
    dim = spark.createDataFrame([(1, "s1"), (2, "s2")], "k int, name string")
    facts = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (3, 10, 3.0)], "k int, day int, x double")
    daily = spark.createDataFrame([(1, 10, 5), (1, 10, 5)], "k int, day int, y int")
    d = relate.assemble(dim, "k", facts, "day", daily_left=[daily.dropDuplicates()])
    p = relate.assemble(dim, "k", facts, "day", daily_left=[daily], parity=True)
    assert d.count() == 2 and p.count() == 2


def test_glm_and_vif(spark):
    import numpy as np
    from tallystack.operators.models import ml
    from tallystack.operators.prep import FeatureSpec
    from tallystack.operators import explain
    rng = np.random.default_rng(0)
    x1 = rng.normal(size=400)
    x2 = x1 + rng.normal(scale=0.5, size=400)
    y = (x1 + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c), "u" if i % 2 else "v")
                                for i, (a, b, c) in enumerate(zip(y, x1, x2))], "y int, x1 double, x2 double, g string")
    spec = FeatureSpec(label="y", numeric=["x1", "x2"], categorical=["g"])
    tab, model = ml.glm_table(spec, df)
    terms = {r["term"]: r for r in tab.collect()}
    assert set(terms) == {"x1", "x2", "g_v", "(Intercept)"}
    from pyspark.ml.functions import array_to_vector
    sc = model.transform(df).withColumn("_p", array_to_vector(F.array(1 - F.col("prediction"), F.col("prediction"))))
    v = {r["term"]: r["gvif"] for r in explain.vif(sc, "features", "_p", {"x1": [0], "x2": [1], "g": [2]}).collect()}
    assert v["x1"] > 2 and v["x2"] > 2 and v["g"] < 1.5


def test_impute_chained_pmm_draws_observed_values(spark):
    rows = [(i, float(i % 10) * 1.5 if i % 5 else None, "x" if i % 2 else "y", float(i % 10))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, c string, b double")
    out = impute.impute_chained(df, {"a": ["c", "b"]}, "k", m=2, max_iter=1, seed=1,
                                numeric_method="pmm", donors=5)
    observed = {r[1] for r in rows if r[1] is not None}
    orig = {r[0]: r[1] for r in rows}
    got = out.collect()
    assert len(got) == 600
    for r in got:
        assert r["a"] is not None and r["a"] in observed
        if orig[r["k"]] is not None:
            assert r["a"] == orig[r["k"]]
    # b predicts a exactly (a = 1.5 b); missing rows have b in {0, 5}, values
    # observed nowhere, so the closest donors sit one step of b away
    for r in got:
        if orig[r["k"]] is None:
            assert abs(r["a"] - 1.5 * r["b"]) <= 1.5 + 1e-6


def test_empty_and_one_class_inputs(spark):
    from tallystack.operators import evaluate, prep
    ev = spark.createDataFrame([], "u long, ts timestamp_ntz, t string")
    g = extract.daily_grid(ev, "u", "ts", F.col("t") == "purchase", count_name="n", flag="f")
    assert g.count() == 0 and g.columns == ["u", "day", "n", "f"]
    s = spark.createDataFrame([(i, float(i), 0) for i in range(20)], "id long, s double, y int")
    m = evaluate.lift_metrics(s, "s", "y", "id").first()
    assert m["gini"] == 0.0 and m["tdl"] is None
    one = spark.createDataFrame([(i, 1) for i in range(5)], "k long, y int")
    o = prep.oversample(one, "y", "k")
    assert o.count() == 5
    assert prep.shuffle_split(one.limit(0), "k").count() == 0
