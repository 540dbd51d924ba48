"""Metric fixtures and properties (ordering, ties, invariance)."""

import random

import pytest
from pyspark.sql import functions as F

from tallystack.operators import evaluate
from tallystack.operators.ordered import ordered_prefix


def scored(spark, scores, labels):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))],
                                 "id long, s double, y int")


def metrics(df):
    return evaluate.lift_metrics(df, "s", "y", "id").first()


def test_tdl_perfect_reversed_constant(spark):
    y = [1] * 10 + [0] * 10
    assert metrics(scored(spark, range(20, 0, -1), y))["tdl"] == pytest.approx(2.0)
    assert metrics(scored(spark, range(20), y))["tdl"] == pytest.approx(0.0)
    # constant score: order by id, so the first two rows (positives) are the top decile
    assert metrics(scored(spark, [0.5] * 20, y))["tdl"] == pytest.approx(2.0)


def test_tdl_null_below_ten_rows_and_auc_null_one_class(spark):
    assert metrics(scored(spark, range(9), [1, 0] * 4 + [1]))["tdl"] is None
    one = scored(spark, range(12), [1] * 12)
    assert evaluate.roc_auc(one, "s", "y").first()["auc"] is None


def brute_gini(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    n, p = len(scores), sum(labels)
    cy, g = 0, 0.0
    for k, i in enumerate(order, 1):
        cy += labels[i]
        if k < n:
            g += (cy / p - k / n) / (1 - k / n)
    return g / n


def test_gini_matches_sequential_with_ties(spark):
    random.seed(3)
    s = [random.choice([0.1, 0.5, 0.5, 0.9, random.random()]) for _ in range(2000)]
    y = [random.randint(0, 1) for _ in s]
    assert metrics(scored(spark, s, y))["gini"] == pytest.approx(brute_gini(s, y), abs=1e-9)


def test_auc_and_gini_invariant_under_monotone_transform(spark):
    random.seed(4)
    s = [random.random() for _ in range(500)]
    y = [1 if random.random() < v else 0 for v in s]
    a = scored(spark, s, y)
    b = a.withColumn("s", F.exp(F.col("s") * 3) + 7)
    assert evaluate.roc_auc(a, "s", "y").first()["auc"] == pytest.approx(evaluate.roc_auc(b, "s", "y").first()["auc"])
    assert metrics(a)["gini"] == pytest.approx(metrics(b)["gini"])


def test_auc_matches_pairwise(spark):
    random.seed(5)
    s = [round(random.random(), 1) for _ in range(300)]
    y = [random.randint(0, 1) for _ in s]
    pos = [v for v, t in zip(s, y) if t]
    neg = [v for v, t in zip(s, y) if not t]
    pw = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(scored(spark, s, y), "s", "y").first()["auc"] == pytest.approx(pw)


def test_ordered_prefix_heavy_value(spark):
    random.seed(6)
    rows = [(i, 0.5 if i % 3 else random.random(), random.randint(0, 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    got = ordered_prefix(df, "s", "id", True, {"c": F.col("y")}).orderBy("rank").collect()
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    c = 0
    for r, g in zip(exp, got):
        c += r[2]
        assert (g["id"], g["c"]) == (r[0], c)


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 4, 4, 3, 1])], "i int, v int")
    assert sorted(r["i"] for r in evaluate.top_n(df, "v", 2).collect()) == [0, 1, 2]


def test_class_summary_two_f1_forms_agree(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "a"), ("a", "a")], "p string, o string")
    r = evaluate.class_summary(df, "p", "o", "a").first()
    tp, fp, fn = 2, 1, 1
    assert r["F1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_grouped_prefix_restarts_per_group(spark):
    from tallystack.operators.ordered import grouped_prefix
    random.seed(8)
    rows = [(g, float(random.choice([1.0, 2.0, 2.0, random.random() * 10 ** g, 1e-20 * random.randint(1, 5)])),
             i, random.randint(0, 1)) for i in range(3000) for g in [i % 3]]
    df = spark.createDataFrame(rows, "g int, v double, id long, y int")
    for desc in (False, True):
        got = {r["id"]: (r["rank"], r["c"]) for r in
               grouped_prefix(df, "g", "v", ["id"], descending=desc, sums={"c": F.col("y")}).collect()}
        for g in range(3):
            grp = sorted([r for r in rows if r[0] == g], key=lambda r: ((-r[1] if desc else r[1]), r[2]))
            c = 0
            for k, r in enumerate(grp, 1):
                c += r[3]
                assert got[r[2]] == (k, c)


def test_ordered_prefix_nulls_last_and_empty(spark):
    rows = [(1, 0.5), (2, None), (3, 0.9), (4, None), (5, 0.1)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = [r["id"] for r in ordered_prefix(df, "s", "id", True).orderBy("rank").collect()]
    assert got == [3, 1, 5, 2, 4]
    empty = df.limit(0)
    assert ordered_prefix(empty, "s", "id", True).count() == 0


def test_importance_auc_matches_single_feature_auc(spark):
    random.seed(11)
    rows = [(i, random.random(), None if i % 17 == 0 else float(random.randint(0, 5)), random.randint(0, 1))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    got = {r["feature"]: r["importance"] for r in evaluate.importance_auc(df, ["a", "b"], "y").collect()}
    for f in ("a", "b"):
        auc = evaluate.roc_auc(df, f, "y").first()["auc"]
        assert got[f] == pytest.approx(max(auc, 1 - auc))
